"""A Merkle manifest of a table: leaves, a tree for each source, a tree over the sources, proofs for every row.

A leaf is the SHA-256 of a row's fields, each `-` if null, else UTF-8 byte count, `:`, value. A source's leaves
ascend by id; every ARITY consecutive nodes (the last run may be shorter, even one) become the digest of
their hex texts until one is left. The sources' roots, in order of their names (null first, bytewise), make the
root in the same way.

Leaves are hashed where the rows are read, so no text is shuffled. Buckets of BUCKET = ARITY ** 3 consecutive leaves
are aligned with the tree: executors hand whole buckets, as Arrow tables of about CHUNK rows, to DuckDB, which
runs the levels inside them by ordered string_agg and sha256. Spark then combines the bucket roots, level by
level, and joins each bucket with the runs beside its path to the root (the outer proof). A second pass of the
executors joins these with the runs inside the buckets into proofs and folded roots. A source may have any share of
the rows: no task holds more than whole buckets, and a run has at most ARITY nodes.

Defined cases: null fields are `-`, so null and empty differ; null ids come first; rows with one id follow by their
leaves, and repeated rows are leaves each; a lone leaf is its source's root; no rows give no proofs; texts of any
length are hashed whole in one row; only the named fields count, other columns are ignored. Each bucket's row of the
outer proof has about 1 KB a level, which is much only where there are about as many sources as rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerlake.llm import scratch
from kmerlake.llm.numbering import numbered
from kmerlake.llm.workers import trimmed

ARITY = 16
INNER = 3  # levels inside a bucket
BUCKET = ARITY**INNER
CHUNK = 2 * BUCKET
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DUCKDB_MEMORY = "400MB"
_OUTER = "array<struct<before string, after string>>"


@dataclass
class Manifest:
    """leaves: key, id, leaf, claimed, pos, bucket, levels. buckets: key, bucket, outer, subroot, root."""

    leaves: DataFrame
    buckets: DataFrame


def digest(fields: Sequence[Column]) -> Column:
    """A row's leaf, 32 bytes."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256))


def _levels(size: Column) -> Column:
    """How many levels stand above a bucket's leaves inside it."""
    inner = F.when(size <= 1, 0)
    for n in range(1, INNER):
        inner = inner.when(size <= ARITY**n, n)
    return inner.otherwise(INNER)


def _run_sql(k: int) -> str:
    """Runs and nodes of level k inside buckets."""
    return f"""
r{k} AS MATERIALIZED (SELECT b, pos // {ARITY} AS pos, any_value(levels) AS levels, string_agg(h, '' ORDER BY pos) AS s FROM n{k - 1} WHERE levels >= {k} GROUP BY b, pos // {ARITY}),
n{k} AS (SELECT b, pos, levels, sha256(s) AS h FROM r{k})"""


_TREE_SQL = "WITH n0 AS (SELECT b, pos, levels, lower(hex(leaf)) AS h FROM rows WHERE pos >= 0)," + ",".join(map(_run_sql, range(1, INNER + 1)))
_ROOTS_SQL = _TREE_SQL + "\nSELECT b, h FROM (" + " UNION ALL ".join(f"SELECT b, h FROM n{k} WHERE levels = {k}" for k in range(INNER + 1)) + ") ORDER BY b"


def _beside(k: int) -> tuple[str, str]:
    """What stands before and after a row's own node in its run of level k."""
    own = f"(l.pos // {ARITY ** (k - 1)}) % {ARITY}"
    return f"substr(r{k}.s, 1, 64 * ({own}))", f"substr(r{k}.s, 64 * ({own}) + 65)"


def _folds_sql() -> str:
    x = "l.x"
    for k in range(1, INNER + 1):
        before, after = _beside(k)
        x = f"CASE WHEN l.levels >= {k} THEN sha256({before} || {x} || {after}) ELSE {x} END"
    siblings = " || ".join(f"coalesce({' || '.join(_beside(k))}, '')" for k in range(1, INNER + 1))
    joins = "".join(f"\nLEFT JOIN r{k} ON r{k}.b = l.b AND r{k}.pos = l.pos // {ARITY**k}" for k in range(1, INNER + 1))
    return f"""{_TREE_SQL},
l AS (SELECT n, b, pos, levels, lower(hex(leaf)) AS leaf, lower(hex(coalesce(claimed, leaf))) AS x FROM rows WHERE pos >= 0),
o AS MATERIALIZED (SELECT b, subroot, root, "outer" AS outside, list_reduce(list_transform("outer", lambda y: y.before || y.after), lambda a, y: a || y, '') AS beside FROM rows WHERE pos < 0),
f AS (SELECT l.n, l.leaf, o.subroot, o.root, sha256({siblings} || o.beside) AS proof_sha256, {x} AS up, o.outside FROM l JOIN o ON o.b = l.b{joins})
SELECT n, leaf, subroot, root, proof_sha256, list_reduce(outside, lambda a, y: sha256(y.before || a || y.after), up) AS folded_root FROM f ORDER BY n"""


_connections: list = []


def _duckdb():
    """One in-memory connection for each worker; it has one thread and leaves no files."""
    if not _connections:
        import duckdb

        _connections.append(duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""}))
    return _connections[0]


def _asked(rows: pa.Table, sql: str) -> pa.Table:
    con = _duckdb()
    con.register("rows", rows)
    try:
        return con.sql(sql).to_arrow_table()
    finally:
        con.unregister("rows")


def _whole_buckets(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.Table]:
    """Tables of whole buckets, about CHUNK rows each, with `b` to number the buckets in it. A bucket begins where pos = first."""
    held: list[pa.RecordBatch] = []

    def numbered_buckets(table: pa.Table) -> pa.Table:
        starts = pc.equal(table["pos"], first).cast(pa.int64())
        return table.append_column("b", pc.cumulative_sum(starts)).append_column("n", pa.array(range(len(table)), pa.int64()))

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < CHUNK:
            continue
        table = pa.Table.from_batches(held)
        starts = pc.indices_nonzero(pc.equal(table["pos"], first)).to_numpy()
        cut = int(starts[-1])
        if cut:
            yield numbered_buckets(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    table = pa.Table.from_batches(held) if held else None
    if table is not None and len(table):
        yield numbered_buckets(table)


def _bucket_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_buckets(batches, 0):
        found = _asked(table.select(["b", "pos", "levels", "leaf"]), _ROOTS_SQL)
        own = table.filter(pc.equal(table["pos"], 0))
        yield from pa.table({"key": own["key"], "bucket": own["bucket"], "h": found["h"]}).cast(pa.schema([("key", pa.string()), ("bucket", pa.int64()), ("h", pa.string())])).to_batches()


def _by_bucket(df: DataFrame) -> DataFrame:
    return df.repartition("key", "bucket").sortWithinPartitions("key", "bucket", "pos")


def _outer_proofs(nodes: DataFrame, above: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """nodes: key, pos, h, n (the key's nodes); above: key, outer, what stands above each key's root, by default nothing.

    Gives roots (key, h) and, for each node, key, pos and outer: what stands before and after its path, from its own
    run up. Levels are built from the nodes up, then each node takes its parent's path from the top down, so a parent
    meets ARITY rows at most.
    """
    levels, runs = [nodes], []
    while True:
        live = levels[-1].filter("n > 1")
        if live.isEmpty():
            break
        together = F.transform(F.sort_array(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"])
        run = live.groupBy("key", F.expr(f"pos div {ARITY}").alias("pos")).agg(F.array_join(together, "").alias("s"), F.ceil(F.max("n") / ARITY).cast("long").alias("n"))
        runs.append(scratch.keep(run, "runs"))
        levels.append(runs[-1].select("key", "pos", F.sha2("s", 256).alias("h"), "n"))
    roots = levels[0].filter("n = 1").select("key", "h")
    for level in levels[1:]:
        roots = roots.unionByName(level.filter("n = 1").select("key", "h"))
    roots = scratch.keep(roots, "roots")
    given = roots.select("key", F.array().cast(_OUTER).alias("outer")) if above is None else above
    found = None
    for i in reversed(range(len(levels))):
        tops = levels[i].filter("n = 1").select("key", "pos").join(given, "key")
        if i < len(runs):
            parents = runs[i].select("key", F.col("pos").alias("up"), "s").join(found.withColumnRenamed("pos", "up"), ["key", "up"])
            own = F.col("pos") % ARITY
            step = F.struct(F.substr("s", F.lit(1), (64 * own).cast("int")).alias("before"), F.substr("s", (64 * own + 65).cast("int")).alias("after"))
            below = levels[i].filter("n > 1").select("key", "pos", F.expr(f"pos div {ARITY}").alias("up")).join(parents, ["key", "up"])
            tops = tops.unionByName(below.select("key", "pos", F.concat(F.array(step), "outer").cast(_OUTER).alias("outer")))
        found = scratch.keep(tops, "outer") if i else tops
    return roots, found


def build(docs: DataFrame, fields: Sequence[str] = FIELDS, id_column: str = "doc_id", source: str = "source", claimed: dict[str, Column] | None = None) -> Manifest:
    """The manifest of docs. claimed: fields as somebody says they are, where rows are to be verified; null stays null."""
    name = F.col(source).cast("string")
    # null first, then by bytes
    key = F.coalesce(F.concat(F.lit("="), name), F.lit(""))
    leaf = digest([F.col(c) for c in fields])
    said = digest([(claimed or {}).get(c, F.col(c)) for c in fields]) if claimed else F.lit(None).cast("binary")
    rows = docs.select(key.alias("key"), F.col(id_column).alias("id"), leaf.alias("leaf"), said.alias("claimed"))
    # sorting by ranges reads its input twice: that must not be the texts
    rows = scratch.keep(rows.withColumn("claimed", F.expr("nullif(claimed, leaf)")), "digests")
    rows = numbered(rows, "key", [F.col("id"), F.col("leaf")], "place")
    leaves = scratch.keep(rows.select("key", "id", "leaf", "claimed", F.expr(f"place div {BUCKET}").alias("bucket"), F.expr(f"place % {BUCKET}").alias("pos"), _levels(F.col("size")).alias("levels"), "size"), "leaves")
    dealt = _by_bucket(leaves.select("key", "bucket", "pos", "levels", "leaf"))
    nodes = scratch.keep(dealt.mapInArrow(trimmed(_bucket_roots), "key string, bucket long, h string"), "buckets")
    n = leaves.filter("pos = 0 AND bucket = 0").select("key", F.ceil(F.col("size") / BUCKET).cast("long").alias("n"))
    nodes = scratch.keep(nodes.join(n, "key").select("key", F.col("bucket").alias("pos"), "h", "n"), "buckets")
    subroots, _ = _outer_proofs(nodes, None)
    ranked = numbered(subroots.select(F.lit("").alias("one"), F.col("key").alias("source_key"), "h"), "one", [F.col("source_key")], "pos", "n")
    ranked = scratch.keep(ranked, "sources")
    root, beside = _outer_proofs(ranked.select(F.col("one").alias("key"), "pos", "h", "n"), None)
    above = scratch.keep(ranked.join(beside.select("pos", "outer"), "pos").select(F.col("source_key").alias("key"), "outer"), "above")
    _, outer = _outer_proofs(nodes, above)
    tops = subroots.select("key", F.col("h").alias("subroot")).crossJoin(F.broadcast(root.select(F.col("h").alias("root"))))  # one root
    buckets = scratch.keep(outer.withColumnRenamed("pos", "bucket").join(tops, "key"), "manifest")
    return Manifest(leaves.drop("size"), buckets)


def proofs(manifest: Manifest) -> DataFrame:
    """For each row: id, leaf, subroot, root, proof_sha256 (of its siblings, level by level), folded_root (from what is claimed) and verified."""
    rows = manifest.leaves.select("key", "bucket", "pos", "levels", "id", "leaf", "claimed", F.lit(None).cast(_OUTER).alias("outer"), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"))
    outer = manifest.buckets.select("key", "bucket", F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("levels"), F.lit(None).cast(manifest.leaves.schema["id"].dataType).alias("id"), F.lit(None).cast("binary").alias("leaf"), F.lit(None).cast("binary").alias("claimed"), "outer", "subroot", "root")
    out = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    kind = manifest.leaves.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_buckets(batches, -1):
            found = _asked(table.drop_columns(["key", "bucket", "id"]), _folds_sql())
            ids = table["id"].take(found["n"])
            yield from pa.table({"id": ids} | {c: found[c].cast(pa.string()) for c in out}).combine_chunks().to_batches()

    found = _by_bucket(rows.unionByName(outer)).mapInArrow(trimmed(run), f"id {kind}, " + ", ".join(f"{c} string" for c in out))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
