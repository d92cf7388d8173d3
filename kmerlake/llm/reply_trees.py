"""Reply trees to training conversations: paths by iterative self-joins, branches by score, one text for each path.

`messages` has a row for each message: tree, node (its id in the tree), parent (another node's id), role, text and
perhaps score; parents and scores may also be given apart, as `links`. A branch is a path from a root to a leaf. All are found by self-joins that double their reach: the
table of jumps of 2 ** i replies joined with itself gives those of 2 ** (i + 1), so a thread of n replies takes
log2(n) joins. Leaves climb the jumps to their roots and add up scores; the best `top` branches of each tree are
then spelled out from the leaf by the same jumps, longest first, and their messages formatted as one conversation.

Only ids and scores take part in that. Texts are shuffled once, by tree, and sorted there within tasks; those of trees
with more than 1 / HOT_SHARE of all messages (so fewer than HOT_SHARE trees, which is what bounds the broadcast
of their ids) are first thinned out by a join on single nodes, so no task reads a hot tree's other branches.
A chosen conversation is one string, and so must fit in a row.

The template: each turn is `### role: text</turn>` and a line break. In roles and texts `\\` is written `\\0`, `</turn>` as `\\1`
and `### ` as `\\2`, in roles `: ` as `\\3`; so no text can end a turn or begin one, and all of them are read back as they
were. `loss` has the places (from 0, in code points) of what the assistant says, as it is escaped.

Defined cases: null roles and texts are empty; a parent that is null, no message's id or the node itself makes a root; nodes
in a circle of replies, and what hangs on it, are in no branch; rows under one id are one node, its parent the least
given, its score the greatest, and all are formatted in order of role and text, repeated rows too; null trees and
null ids are a tree and a node like others, though nobody can reply to a null id. Without a score all are 0; branches
of equal score go by more messages, then by the smaller leaf. No messages give no conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kmerlake.llm import scratch

HOT_SHARE = 1000
ASSISTANT = "assistant"
#: What is written for what, in this order; read back the other way round.
CODES = (("\\", "\\0"), ("</turn>", "\\1"), ("### ", "\\2"))
ROLE_CODES = (*CODES, (": ", "\\3"))
HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"


def _escaped(text: Column, codes=CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _unescaped(text: Column, codes=CODES) -> Column:
    # each backslash has its digit, so only the backslash itself must wait
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _same(a: DataFrame, b: DataFrame, **names: str) -> Column:
    """Equal columns, null being a value."""
    out = None
    for x, y in names.items():
        equal = a[x].eqNullSafe(b[y])
        out = equal if out is None else out & equal
    return out


def _nodes(links: DataFrame) -> DataFrame:
    """links: tree, node, parent and perhaps score. Each id once, and how many rows it had."""
    score = F.max(F.coalesce(F.col("score").cast("double"), F.lit(0.0))) if "score" in links.columns else F.lit(0.0)
    return links.groupBy("tree", "node").agg(F.min("parent").alias("parent"), score.alias("score"), F.count("*").alias("rows"))


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """For each i, the nodes with a 2 ** i-th message above: tree, node, to, gain (scores of the messages above them, up to `to`)."""
    up = nodes.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("score").alias("gain"))
    below = nodes.filter(F.col("parent").isNotNull() & ~F.col("parent").eqNullSafe(F.col("node")))
    first = below.join(up, _same(below, up, tree="_tree") & (below["parent"] == up["_node"])).select("tree", "node", F.col("parent").alias("to"), "gain")
    found, most = [scratch.keep(first, "jumps")], nodes.count()
    # circles never end, but no path is longer than all nodes
    while 2 ** len(found) <= most:
        last = found[-1]
        far = last.select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), F.col("to").alias("_to"), F.col("gain").alias("_gain"))
        longer = last.join(far, _same(last, far, tree="_tree") & (last["to"] == far["_node"])).select("tree", "node", F.col("_to").alias("to"), (F.col("gain") + F.col("_gain")).alias("gain"))
        longer = scratch.keep(longer, "jumps")
        if longer.isEmpty():
            break
        found.append(longer)
    return found


def _climbed(leaves: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """leaves: tree, leaf, at, steps, total. Moves each as far up as there are messages."""
    for i in reversed(range(len(jumps))):
        far = jumps[i].select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), "to", "gain")
        moved = leaves.join(far, _same(leaves, far, tree="_tree", at="_node"), "left")
        known = F.col("to").isNotNull()
        leaves = moved.select("tree", "leaf", F.when(known, F.col("to")).otherwise(F.col("at")).alias("at"), (F.col("steps") + F.when(known, 2**i).otherwise(0)).alias("steps"), (F.col("total") + F.coalesce("gain", F.lit(0.0))).alias("total"))
    return leaves


def branches(links: DataFrame) -> DataFrame:
    """All root-to-leaf paths: tree, leaf, root, length (messages), total (their scores) and rank (1 is the tree's best)."""
    nodes = scratch.keep(_nodes(links), "nodes")
    return _branches(nodes, _jumps(nodes))


def _branches(nodes: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    parents = jumps[0].select(F.col("tree").alias("_tree"), F.col("to").alias("_node")).distinct()
    leaves = nodes.join(parents, _same(nodes, parents, tree="_tree") & (nodes["node"] == parents["_node"]), "left_anti")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), F.col("node").alias("at"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total"))
    ends = _climbed(leaves, jumps)
    # an end that still has a message above is in a circle
    below = jumps[0].select(F.col("tree").alias("_tree"), F.col("node").alias("_node"))
    ends = ends.join(below, _same(ends, below, tree="_tree", at="_node"), "left_anti")
    best = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("steps"), F.asc("leaf"))
    return ends.select("tree", "leaf", F.col("at").alias("root"), F.col("steps").alias("length"), "total", F.row_number().over(best).alias("rank"))


def _spelled(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """chosen: tree, rank, leaf. Every message of their paths: tree, rank, node, up (0 is the leaf)."""
    paths = chosen.select("tree", "rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for i in reversed(range(len(jumps))):
        far = jumps[i].select(F.col("tree").alias("_tree"), F.col("node").alias("_node"), "to")
        met = paths.join(far, _same(paths, far, tree="_tree", node="_node"), "left")
        here, there = F.struct("node", "up"), F.struct(F.col("to").alias("node"), (F.col("up") + 2**i).alias("up"))
        both = F.when(F.col("to").isNotNull(), F.array(here, there)).otherwise(F.array(here))
        paths = met.select("tree", "rank", F.explode(both).alias("x")).select("tree", "rank", "x.node", "x.up")
    return paths


def _placed(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """The messages of the paths with rank and up. Messages are dealt by tree and sorted there; a path's rows come with them."""
    none = F.lit(None)
    said = messages.select("tree", "node", "role", "text", none.cast("array<struct<rank int, up long>>").alias("on"))
    spots = paths.groupBy("tree", "node").agg(F.collect_list(F.struct("rank", "up")).alias("on"))
    both = said.unionByName(spots.select("tree", "node", none.cast("string").alias("role"), none.cast("string").alias("text"), "on").withColumn("_path", F.lit(True)), allowMissingColumns=True)
    dealt = both.repartition("tree")
    node = Window.partitionBy("tree", "node").orderBy(F.asc_nulls_last("_path"))
    met = dealt.withColumn("on", F.first("on").over(node)).filter("_path IS NULL AND on IS NOT NULL")
    return met.select("tree", "role", "text", F.explode("on").alias("x")).select("tree", "x.rank", "x.up", "role", "text")


def conversations(messages: DataFrame, top: int = 1, links: DataFrame | None = None) -> DataFrame:
    """tree, rank, text, loss: the best `top` branches of each tree, each formatted as one conversation."""
    nodes = scratch.keep(_nodes(messages if links is None else links), "nodes")
    jumps = _jumps(nodes)
    chosen = scratch.keep(_branches(nodes, jumps).filter(F.col("rank") <= top), "branches")
    paths = scratch.keep(_spelled(chosen, jumps), "paths")
    total = nodes.agg(F.sum("rows")).first()[0] or 0
    hot = nodes.groupBy("tree").agg(F.sum("rows").alias("n")).filter(F.col("n") * HOT_SHARE > total)
    hot = F.broadcast(scratch.keep(hot.select(F.col("tree").alias("_hot")), "hot"))  # fewer than HOT_SHARE
    said = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own, others = (said.join(hot, _same(said, hot, tree="_hot"), how) for how in ("left_semi", "left_anti"))
    walked = paths.select(F.col("tree").alias("_tree"), F.col("node").alias("_node")).distinct()
    walked = walked.join(hot, F.col("_tree").eqNullSafe(F.col("_hot")), "left_semi")
    own = own.join(walked, _same(own, walked, tree="_tree", node="_node"), "left_semi")
    return _formatted(_placed(own.unionByName(others), paths))


def _formatted(turns: DataFrame) -> DataFrame:
    """turns: tree, rank, up, role, text."""
    head = F.concat(F.lit(HEAD), _escaped(F.col("role"), ROLE_CODES), F.lit(COLON))
    body = _escaped(F.col("text"))
    parts = turns.select("tree", "rank", "up", "role", head.alias("head"), body.alias("body"))
    parts = parts.withColumn("size", F.length("head") + F.length("body") + len(TAIL))
    inside = Window.partitionBy("tree", "rank").orderBy(F.desc("up"), "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(inside), F.lit(0)).cast("long")
    own = F.when(F.col("role") == ASSISTANT, F.struct((F.col("start") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")))
    placed = parts.withColumn("start", start).select("tree", "rank", F.struct("start", F.concat("head", "body", F.lit(TAIL)).alias("turn"), own.alias("loss")).alias("x"))
    whole = placed.groupBy("tree", "rank").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return whole.select("tree", "rank", F.array_join(F.transform("x", lambda x: x["turn"]), "").alias("text"), F.filter(F.transform("x", lambda x: x["loss"]), lambda y: y.isNotNull()).alias("loss"))


def write_conversations(messages: DataFrame, path: str, top: int = 1, links: DataFrame | None = None) -> None:
    conversations(messages, top, links).write.option("compression", "zstd").parquet(path)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """What write_conversations wrote, and `turns` (role, text) and `learned`, the texts under the loss, as they were."""
    read = spark.read.parquet(path)

    def turn(piece: Column) -> Column:
        colon = F.locate(COLON, piece, len(HEAD) + 1)
        role = F.substr(piece, F.lit(len(HEAD) + 1), colon - len(HEAD) - 1)
        return F.struct(_unescaped(role, ROLE_CODES).alias("role"), _unescaped(F.substr(piece, colon + len(COLON))).alias("text"))

    pieces = F.filter(F.split("text", TAIL, -1), lambda x: x != "")
    learned = F.transform("loss", lambda s: _unescaped(F.substr("text", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return read.withColumns({"turns": F.transform(pieces, turn), "learned": learned})


def linear(rows: DataFrame, tree: str, turn: str) -> tuple[DataFrame, DataFrame]:
    """(messages, links) of conversations without branches: each turn replies to the one before. A null turn is the first."""
    place = F.coalesce(F.col(turn).cast("long"), F.lit(-(2**63)))
    messages = rows.select(F.col(tree).alias("tree"), place.alias("node"), "role", "text")
    before = F.lag("node").over(Window.partitionBy("tree").orderBy("node"))
    return messages, messages.select("tree", "node").distinct().withColumn("parent", before)
