"""DuckDB twins of the core queries."""

from __future__ import annotations

from kmerlake.functions.dna import BASES, LETTERS
from kmerlake.functions.stats import ERF_A, ERF_P, Z95
from kmerlake.operators.kernel import SEEDS

K, S = 31, 9


def dna(text: str) -> str:
    return f"translate(lower({text}), '{LETTERS}', '{(BASES * 7)[: len(LETTERS)]}')"


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def _md5_rank(m: str, s: int) -> str:
    return f"('0x' || substr(md5(least({m}, {_rc(m)})), 1, 15))::BIGINT"


def rolling_rank(m: str, s: int) -> str:
    """The lesser of both strands' sums (xor) of the bases' seeds, each turned left by its place."""

    def strand(letters: str, by: str) -> str:
        seed = f"{SEEDS.tolist()}[instr('{letters}', substr({m}, (j + 1)::INT, 1))]::BIGINT"
        turned = f"((({seed}) << (({by}) % 32)::INT) & 4294967295) | (({seed}) >> (32 - ({by}) % 32)::INT)"
        return f"list_reduce(list_transform(range({s}), lambda j: {turned}), lambda a, b: xor(a, b))"

    return f"least({strand('ACGT', f'{s - 1} - j')}, {strand('TGCA', 'j')})"


def mers(name: str, src: str, k: int = K, s: int = S, rank=_md5_rank) -> str:
    """CTEs that end in `name`: id, pos, kmer of src (id, seq). rank: how s-mers are ordered."""
    half = (k - s) // 2
    return f"""{name}_m AS (SELECT id, i, substr(seq, i, {s}) AS m FROM (SELECT id, seq, unnest(range(1, length(seq) - {s - 2})) AS i FROM {src} WHERE length(seq) >= {k})),
{name}_h AS (SELECT id, i, CASE WHEN NOT regexp_matches(m, '[^ACGT]') THEN {rank("m", s)} END AS h FROM {name}_m),
{name}_w AS (SELECT id, i, h, min(h) OVER w AS lo, count(h) OVER w AS n FROM {name}_h WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)),
{name}_p AS (SELECT id, i - {half + 1} AS pos FROM {name}_w WHERE n = {k - s + 1} AND h = lo),
{name}_k AS (SELECT p.id, p.pos, substr(x.seq, p.pos + 1, {k}) AS m FROM {name}_p p JOIN {src} x USING (id)),
{name} AS MATERIALIZED (SELECT id, pos, least(m, {_rc("m")}) AS kmer FROM {name}_k)"""


TARGETS = f"t AS (SELECT item_id AS id, 'item ' || item_id AS target, {dna('text')} AS seq FROM benchmark),\n" + mers("tk", "t")
READS = f"r AS (SELECT doc_id AS id, lang AS sample, {dna('text')} AS seq FROM documents),\n" + mers("rk", "r")
BY_SOURCE = READS.replace("lang AS sample", "source AS sample")
TURNS = f"r AS (SELECT conv_id * 100000 + turn AS id, conv_id, turn, role AS sample, {dna('text')} AS seq FROM conversations)"
MERGED = (
    f"""b AS (SELECT item_id AS id, item_id % 4 AS g, 'group' || (item_id % 4) AS target, {dna("text")} AS seq FROM benchmark),
{mers("bk", "b")},
o AS (SELECT id, g, target, coalesce(sum(length(seq)) OVER (PARTITION BY g ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off, sum(length(seq)) OVER (PARTITION BY g)::BIGINT AS length FROM b),
mk AS MATERIALIZED (SELECT o.g, o.target, o.length, o.off + bk.pos AS pos, bk.kmer FROM bk JOIN o USING (id))"""
)
CONTAINMENT = """td AS MATERIALIZED (SELECT DISTINCT id, kmer FROM tk),
ab AS MATERIALIZED (SELECT sample, kmer, least(count(*), 65535)::BIGINT AS depth FROM rk JOIN r USING (id) WHERE kmer IN (SELECT kmer FROM tk) GROUP BY ALL),
sz AS (SELECT id, count(*) AS n FROM td GROUP BY 1),
sm AS (SELECT sample, count(*)::BIGINT AS sample_seqs, sum(length(seq))::BIGINT AS sample_bases FROM r GROUP BY 1),
h AS MATERIALIZED (SELECT sample, id, depth FROM td JOIN ab USING (kmer)),
hs AS (SELECT sample, id, count(*) AS h1, count(*) FILTER (depth >= 2) AS h2, count(*) FILTER (depth >= 10) AS h10, median(depth)::DOUBLE AS med FROM h GROUP BY ALL),
c0 AS (SELECT sm.sample, t.id, t.target, length(t.seq)::BIGINT AS target_length, sample_seqs, sample_bases, coalesce(sz.n, 0)::BIGINT AS n,
  coalesce(h1, 0)::BIGINT AS h1, coalesce(h2, 0)::BIGINT AS h2, coalesce(h10, 0)::BIGINT AS h10, coalesce(med, 0.0) AS med
  FROM t CROSS JOIN sm LEFT JOIN sz ON sz.id = t.id LEFT JOIN hs ON hs.id = t.id AND hs.sample = sm.sample),
c AS MATERIALIZED (SELECT *, CASE WHEN n > 0 THEN h1 / n::DOUBLE ELSE 0.0 END AS c1, CASE WHEN n > 0 THEN h2 / n::DOUBLE ELSE 0.0 END AS c2, CASE WHEN n > 0 THEN h10 / n::DOUBLE ELSE 0.0 END AS c10 FROM c0)"""
FULL = f"{TARGETS},\n{READS},\n{CONTAINMENT}"
TOTALS = """tot AS (SELECT *, FALSE AS is_total FROM c UNION ALL BY NAME
  SELECT sample, NULL::BIGINT AS id, 'TOTAL' AS target, 0::BIGINT AS target_length, sample_seqs, sample_bases, sum(n)::BIGINT AS n, sum(h1)::BIGINT AS h1, sum(h2)::BIGINT AS h2, sum(h10)::BIGINT AS h10, NULL::DOUBLE AS med,
    CASE WHEN sum(n) > 0 THEN sum(h1) / sum(n)::DOUBLE ELSE 0.0 END AS c1, CASE WHEN sum(n) > 0 THEN sum(h2) / sum(n)::DOUBLE ELSE 0.0 END AS c2, CASE WHEN sum(n) > 0 THEN sum(h10) / sum(n)::DOUBLE ELSE 0.0 END AS c10, TRUE AS is_total
  FROM c GROUP BY sample, sample_seqs, sample_bases)"""
HIST = """hi AS (SELECT sample, id, depth, count(*)::BIGINT AS n FROM h GROUP BY ALL),
mo AS (SELECT sample, id, (max((n, depth)))[2] AS mode, (max((n, depth)))[1] AS at_mode FROM hi GROUP BY ALL),
mo2 AS (SELECT mo.*, coalesce(x.n, 0)::BIGINT AS after_mode FROM mo LEFT JOIN hi x ON x.sample = mo.sample AND x.id = mo.id AND x.depth = mo.mode + 1)"""


def wilson(x: str, n: str) -> tuple[str, str]:
    z2 = Z95**2
    p = f"({x} / {n}::DOUBLE)"
    spread = f"{Z95!r} * sqrt({p} * (1 - {p}) / {n} + {z2!r} / (4.0 * {n} * {n}))"
    mid, scale = f"({p} + {z2!r} / (2.0 * {n}))", f"(1 + {z2!r} / {n})"
    return (
        f"CASE WHEN {n} > 0 THEN greatest(0.0, ({mid} - {spread}) / {scale}) ELSE 0.0 END",
        f"CASE WHEN {n} > 0 THEN least(1.0, ({mid} + {spread}) / {scale}) ELSE 0.0 END",
    )


def erf(x: str) -> str:
    t = f"(1 / (1 + {ERF_P!r} * abs({x})))"
    poly = "0.0"
    for a in reversed(ERF_A):
        poly = f"({poly} + {a!r}::DOUBLE) * {t}"
    y = f"(1 - {poly} * exp(-({x}) * ({x})))"
    return f"CASE WHEN {x} < 0 THEN -{y} ELSE {y} END"


def survival(x: str) -> str:
    return f"greatest(0.0, least(1.0, (1 - ({erf(f'(({x}) / sqrt(2.0::DOUBLE))')})) / 2))"


def runs(n: str, h: str, r: str) -> str:
    m = f"({n} - {h})::DOUBLE"
    prod = f"(2.0::DOUBLE * {h} * {m})"
    var = f"({prod} * ({prod} - {n}) / ({n}::DOUBLE * {n} * ({n} - 1)))"
    return f"CASE WHEN {n} >= 50 AND {h} >= 10 AND {n} - {h} >= 10 THEN CASE WHEN {var} > 0 THEN -({r} - (1 + {prod} / {n})) / sqrt({var}) END END"


LAMBDA = "CASE WHEN n >= 50 AND med <= 2 AND h1 >= 25 AND at_mode >= 3 AND after_mode >= 3 THEN after_mode / at_mode::DOUBLE * (mode + 1) END"
ANI = f"""l AS (SELECT c.*, {LAMBDA} AS rate FROM c LEFT JOIN mo2 USING (sample, id)),
a AS (SELECT *, pow(CASE WHEN rate IS NOT NULL AND 1 - exp(-rate) > 0 THEN greatest(0.0, least(1.0, c1 / (1 - exp(-rate)))) ELSE c1 END, 1.0 / {K}) AS est FROM l),
ani AS MATERIALIZED (SELECT *, CASE WHEN n >= 50 AND c1 > 0 AND est >= 0.9 THEN est END AS ani_est FROM a)"""


def patchy(tk: str, key: str, samples: str) -> str:
    return f"""once AS (SELECT {key}, pos, kmer FROM {tk} QUALIFY count(*) OVER (PARTITION BY {key}, kmer) = 1),
lab AS (SELECT s.sample, once.{key}, once.pos, (ab.depth IS NOT NULL)::INT AS hit FROM once CROSS JOIN (SELECT DISTINCT sample FROM {samples}) s LEFT JOIN ab ON ab.sample = s.sample AND ab.kmer = once.kmer),
trn AS (SELECT *, coalesce((hit <> lag(hit) OVER (PARTITION BY sample, {key} ORDER BY pos))::INT, 1) AS turn FROM lab),
rs AS (SELECT sample, {key}, count(*)::BIGINT AS n, sum(hit)::BIGINT AS hits, sum(turn)::BIGINT AS runs FROM trn GROUP BY ALL),
pz AS MATERIALIZED (SELECT *, {runs("n", "hits", "runs")} AS z FROM rs)"""


def classified(reads: str, index: str = "gk", abs_threshold: int = 1, rel: float = 0.0) -> str:
    every = "SELECT n.id, g.g, coalesce(hh.hits, 0) AS hits, n.n FROM n CROSS JOIN (SELECT unnest(range(4)) AS g) g LEFT JOIN hh ON hh.id = n.id AND hh.g = g.g"
    return f"""{MERGED.replace("mk AS MATERIALIZED", "mk AS")},
{reads},
gk0 AS MATERIALIZED (SELECT DISTINCT kmer, g FROM mk),
gd AS (SELECT kmer, min(g) AS g FROM gk0 GROUP BY 1 HAVING count(*) = 1),
gk AS MATERIALIZED (SELECT * FROM {"gd" if index == "gd" else "gk0"}),
n AS (SELECT id, count(*)::BIGINT AS n FROM rk GROUP BY 1),
hh AS (SELECT id, g, count(*)::BIGINT AS hits FROM rk JOIN gk USING (kmer) GROUP BY ALL),
ev AS ({every}),
ma AS (SELECT * FROM ev WHERE hits >= {abs_threshold} AND hits / n::DOUBLE >= {rel!r}::DOUBLE),
li AS (SELECT id, count(*) AS m, string_agg('group' || g, ',' ORDER BY g) AS gs, string_agg(hits::VARCHAR, ',' ORDER BY g) AS hs FROM ma GROUP BY 1),
ps AS MATERIALIZED (SELECT r.sample, r.id AS seq_id, CASE WHEN m = 1 THEN 'classified' WHEN m > 1 THEN 'ambiguous' ELSE 'unclassified' END AS classification,
  coalesce(gs, '.') AS "group", coalesce(hs, '0') AS hits, coalesce(n.n, 0)::BIGINT AS seq_kmers, length(r.seq)::BIGINT AS seq_length
  FROM r LEFT JOIN n USING (id) LEFT JOIN li USING (id)),
bu AS (SELECT sample, seq_id, CASE WHEN classification = 'classified' THEN "group" ELSE classification END AS bucket, seq_length FROM ps)"""


SUMMARY = """nm AS (SELECT 'group' || i AS bucket, i FROM range(4) x(i) UNION ALL SELECT * FROM (VALUES ('ambiguous', 1000), ('unclassified', 1001))),
ct AS (SELECT sample, bucket, count(*)::BIGINT AS seqs, sum(seq_length)::BIGINT AS bases FROM bu GROUP BY ALL),
gr AS (SELECT s.sample, nm.bucket, nm.i, coalesce(ct.seqs, 0) AS seqs, coalesce(ct.bases, 0) AS bases FROM (SELECT DISTINCT sample FROM bu) s CROSS JOIN nm LEFT JOIN ct ON ct.sample = s.sample AND ct.bucket = nm.bucket),
su AS (SELECT sample, bucket AS "group", i, seqs, bases, CASE WHEN sum(seqs) OVER w > 0 THEN 100 * seqs / (sum(seqs) OVER w)::DOUBLE ELSE 0.0 END AS seqs_pct, CASE WHEN sum(bases) OVER w > 0 THEN 100 * bases / (sum(bases) OVER w)::DOUBLE ELSE 0.0 END AS bases_pct FROM gr WINDOW w AS (PARTITION BY sample))"""


def lenhist(bucketed: str) -> str:
    return f"""ln AS (SELECT sample, bucket AS "group", seq_length AS length, count(*)::BIGINT AS count FROM {bucketed} GROUP BY ALL),
lh AS (SELECT *, sum(count) OVER (PARTITION BY sample)::BIGINT AS total_seqs_processed, sum(length * count) OVER (PARTITION BY sample)::BIGINT AS total_bp_processed,
  sum(count) OVER (PARTITION BY sample, "group")::BIGINT AS group_seqs, sum(length * count) OVER (PARTITION BY sample, "group")::BIGINT AS group_bases FROM ln)"""


ALL_TURNS = TURNS + ",\nbu AS (SELECT sample, 'all' AS bucket, length(seq)::BIGINT AS seq_length FROM r),\n" + lenhist("bu")
DUMP_T = "SELECT target, pos AS position, kmer FROM tk JOIN t USING (id)"
_LO, _HI = wilson("h1", "n")
_R8 = lambda *cols: ", ".join(f"round({c}, 8) AS {a}" for c, a in cols)


_INTERVALS = [(side, f"containment{t}_{name}") for t in (1, 2) for side, name in zip(wilson(f"h{t}", "ani.n"), ("lo", "hi"), strict=True)]


def _sort(order: str) -> str:
    return f"WITH {FULL},\n{TOTALS}\nSELECT row_number() OVER (ORDER BY sample, is_total, {order}id NULLS LAST)::BIGINT AS rank, sample, target FROM tot"


def _format(n: str, infix: str, whole: str, suffix: str) -> str:
    cases = " ".join(f"WHEN {n} >= {size} THEN printf('%.1f', {n} / {size}.0::DOUBLE) || '{infix}{unit}bp{suffix}'" for size, unit in ((10**9, "G"), (10**6, "M"), (10**3, "K")))
    return f"CASE {cases} ELSE {whole} END"


_HITS = "bg AS MATERIALIZED (SELECT DISTINCT kmer FROM rk)"
_X = "((l_extendedprice - 30000) / 10000)"
_MU = "(l_quantity / 10)"
_DISC = "SELECT target, pos AS position, kmer FROM {0} WHERE kmer IN (SELECT kmer FROM {0} GROUP BY 1 HAVING count(DISTINCT g) = 1)"

_BINS = f"""WITH r AS (SELECT source AS sample, length({dna("text")})::BIGINT AS length FROM documents),
b AS (SELECT sample, (length // 500 * 500)::BIGINT AS bin, count(*)::BIGINT AS n, count(*) / 500.0::DOUBLE AS density FROM r GROUP BY 1, 2)"""

ORACLES: dict[str, str] = {
    "syncmers_documents": f"WITH {READS}\nSELECT id AS seq_id, pos, kmer FROM rk",
    "syncmers_positions": f"WITH {TARGETS}\n{DUMP_T}",
    "syncmers_dataframe_form": f"WITH {TARGETS}\n{DUMP_T}",
    "syncmers_k33": f"WITH t AS (SELECT item_id AS id, {dna('text')} AS seq FROM benchmark),\n{mers('tk', 't', 33)}\nSELECT id AS target_idx, pos, kmer FROM tk",
    "syncmers_k15": f"WITH {TURNS},\n{mers('rk', 'r', 15, 7)}\nSELECT conv_id, turn, pos, kmer FROM rk JOIN r USING (id)",
    "syncmers_chunked": f"WITH {READS}\nSELECT id AS seq_id, pos, kmer FROM rk",
    "ambiguous_skip": f"WITH {TURNS},\n{mers('rk', 'r')},\nn AS (SELECT id, count(*) AS n FROM rk GROUP BY 1)\nSELECT conv_id, turn, greatest(length(seq) - {K - 1}, 0)::BIGINT AS windows, coalesce(n, 0)::BIGINT AS selected, NOT regexp_matches(seq, '[^ACGT]') AS unambiguous FROM r LEFT JOIN n USING (id)",
    "kmer_decode": f"WITH {TARGETS}\nSELECT id AS target_idx, kmer, {_rc('kmer')} AS reverse_complement FROM tk",
    "syncmers_k61": f"WITH t AS (SELECT item_id AS id, {dna('text')} AS seq FROM benchmark),\n{mers('tk', 't', 61)}\nSELECT id AS target_idx, pos, kmer FROM tk",
    "abundance_k61": f"WITH t AS (SELECT item_id AS id, {dna('text')} AS seq FROM benchmark),\n{mers('tk', 't', 61)},\nr AS (SELECT doc_id AS id, lang AS sample, {dna('text')} AS seq FROM documents),\n{mers('rk', 'r', 61)}\nSELECT sample, kmer, least(count(*), 65535)::BIGINT AS depth FROM rk JOIN r USING (id) WHERE kmer IN (SELECT kmer FROM tk) GROUP BY ALL",
    "syncmers_rolling": f"WITH t AS (SELECT item_id AS id, {dna('text')} AS seq FROM benchmark),\n{mers('tk', 't', 31, 11, rolling_rank)}\nSELECT id AS target_idx, pos, kmer FROM tk",
    "syncmers_rolling_dataframe_form": f"WITH t AS (SELECT item_id AS id, {dna('text')} AS seq FROM benchmark),\n{mers('tk', 't', 31, 11, rolling_rank)}\nSELECT id AS target_idx, pos, kmer FROM tk",
    "fracminhash": f"WITH {TARGETS}\n{DUMP_T} WHERE ('0x' || substr(md5(kmer), 1, 15))::BIGINT <= {int(0.1 * (1 << 60))}",
    "target_distinct": f"WITH {TARGETS}\nSELECT t.target, length(t.seq)::BIGINT AS length, count(DISTINCT kmer)::BIGINT AS target_kmers FROM t LEFT JOIN tk USING (id) GROUP BY t.id, t.target, t.seq",
    "target_union": f"WITH {TARGETS}\nSELECT DISTINCT kmer FROM tk",
    "target_merge_offsets": f"WITH {MERGED}\nSELECT target, length, pos AS position, kmer FROM mk",
    "shared_kmers": f"WITH {TARGETS},\nx AS (SELECT kmer, count(DISTINCT id) AS n FROM tk GROUP BY 1)\nSELECT count(*)::BIGINT AS distinct_kmers, count(*) FILTER (n > 1)::BIGINT AS shared_kmers, count(*) FILTER (n = 1)::BIGINT AS unique_kmers, coalesce(sum(n), 0)::BIGINT AS target_kmers FROM x",
    "target_summary": f"""WITH {MERGED},
x AS (SELECT kmer, count(DISTINCT g) AS n FROM mk GROUP BY 1),
y AS (SELECT count(*)::BIGINT AS distinct_kmers, count(*) FILTER (n > 1)::BIGINT AS shared_kmers, count(*) FILTER (n = 1)::BIGINT AS unique_kmers, coalesce(sum(n), 0)::BIGINT AS target_kmers FROM x)
SELECT (SELECT count(DISTINCT g) FROM b)::BIGINT AS targets, (SELECT count(*) FROM b)::BIGINT AS records, (SELECT coalesce(sum(length(seq)), 0) FROM b)::BIGINT AS bases, y.*,
  CASE WHEN distinct_kmers > 0 THEN round(100 * shared_kmers / distinct_kmers::DOUBLE, 8) ELSE 0.0 END AS shared_pct FROM y""",
    "discriminatory": f"WITH {MERGED}\n{_DISC.format('mk')}",
    "background_mask": f"WITH {TARGETS},\n{READS},\n{_HITS}\n{DUMP_T} WHERE kmer NOT IN (SELECT kmer FROM bg)",
    "background_hits": f"WITH {TARGETS},\n{READS},\n{_HITS}\nSELECT count(DISTINCT kmer)::BIGINT AS masked_kmers FROM tk WHERE kmer IN (SELECT kmer FROM bg)",
    "mask_then_discriminate": f"WITH {MERGED},\n{READS},\n{_HITS},\nlk AS (SELECT * FROM mk WHERE kmer NOT IN (SELECT kmer FROM bg))\n{_DISC.format('lk')}",
    "self_background": "SELECT 0::BIGINT AS target_kmers",
    "abundance": f"WITH {FULL}\nSELECT sample, kmer, depth FROM ab",
    "abundance_saturated": "SELECT l_returnflag AS sample, l_linestatus AS kmer, least(count(*), 65535)::BIGINT AS depth FROM lineitem GROUP BY ALL",
    "kmers_found": f"WITH {FULL}\nSELECT sample, count(DISTINCT kmer)::BIGINT AS kmers_found FROM ab GROUP BY 1",
    "containment1": f"WITH {FULL}\nSELECT sample, target, round(c1, 8) AS containment1, h1 AS containment1_hits, n AS target_kmers FROM c",
    "containment_thresholds": f"WITH {FULL}\nSELECT sample, target, {_R8(('c1', 'containment1'), ('c2', 'containment2'), ('c10', 'containment10'))}, h2 AS containment2_hits, h10 AS containment10_hits FROM c",
    "containment_by_source": f"WITH {TARGETS},\n{BY_SOURCE},\n{CONTAINMENT}\nSELECT sample, target, round(c1, 8) AS containment1, h1 AS containment1_hits, med AS median_nz_abundance FROM c",
    "median_nz": f"WITH {FULL}\nSELECT sample, target, med AS median_nz_abundance FROM c",
    "depth_histogram": f"WITH {FULL},\n{HIST}\nSELECT sample, id AS target_idx, depth, n FROM hi",
    "depth_mode": f"WITH {FULL},\n{HIST}\nSELECT sample, id AS target_idx, mode, at_mode, after_mode FROM mo2",
    "total_rows": f"WITH {FULL},\n{TOTALS}\nSELECT sample, target, n AS target_kmers, target_length, h1 AS containment1_hits, round(c1, 8) AS containment1, h10 AS containment10_hits, med AS median_nz_abundance, sample_seqs, sample_bases FROM tot WHERE is_total",
    "sort_containment": _sort("c1 DESC, "),
    "sort_target": _sort("target, "),
    "sort_input": _sort(""),
    "sort_samples_given": _sort("target, ").replace("ORDER BY sample", "ORDER BY CASE sample WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 3 END, sample"),
    "wilson_ci": f"WITH {FULL}\nSELECT sample, target, {_R8((_LO, 'lo'), (_HI, 'hi'))} FROM c",
    "wilson_orders": f"WITH c AS (SELECT o_custkey, count(*)::BIGINT AS n, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS h1 FROM orders GROUP BY 1)\nSELECT o_custkey, h1 AS x, n, {_R8((_LO, 'lo'), (_HI, 'hi'))} FROM c",
    "erf_survival": f"SELECT l_orderkey, l_linenumber, {_R8((erf(_X), 'erf'), (survival(_X), 'survival'))} FROM lineitem",
    "poisson_tail": f"""SELECT l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, 1 - exp(-{_MU}))), 8) AS at_least_1, round(greatest(0.0, least(1.0, 1 - exp(-{_MU}) * (1 + {_MU}))), 8) AS at_least_2,
  round(greatest(0.0, least(1.0, 1 - exp(-{_MU}) * (1 + {_MU} + pow({_MU}, 2) / 2 + pow({_MU}, 3) / 6 + pow({_MU}, 4) / 24))), 8) AS at_least_5 FROM lineitem""",
    "lambda_est": f"WITH {FULL},\n{HIST},\n{ANI}\nSELECT sample, target, round(rate, 8) AS depth_rate FROM ani",
    "lambda_lines": f"""WITH ln AS (SELECT l_orderkey, l_returnflag AS sample, count(*)::BIGINT AS depth FROM lineitem GROUP BY ALL),
h AS (SELECT sample, 0 AS id, depth FROM ln),
{HIST},
c AS (SELECT sample, 0 AS id, count(*)::BIGINT AS n, count(*)::BIGINT AS h1, median(depth)::DOUBLE AS med, 0.5::DOUBLE AS c1 FROM ln GROUP BY 1),
{ANI}
SELECT sample, mode, at_mode, after_mode, round(rate, 8) AS depth_rate, round(ani_est, 8) AS ani_est FROM ani JOIN mo2 USING (sample, id)""",
    "ani_est": f"WITH {FULL},\n{HIST},\n{ANI}\nSELECT sample, target, round(ani_est, 8) AS ani_est FROM ani",
    "runs_patchiness": f"WITH {MERGED},\n{READS},\nab AS (SELECT sample, kmer, count(*) AS depth FROM rk JOIN r USING (id) WHERE kmer IN (SELECT kmer FROM mk) GROUP BY ALL),\n{patchy('mk', 'g', 'r')}\nSELECT sample, g AS target_idx, n, hits, runs, round(z, 8) AS z, CASE WHEN z IS NOT NULL THEN round({survival('z')}, 8) END AS p FROM pz",
    "runs_events": f"""WITH e AS (SELECT *, (user_id % 3 = 0)::INT AS hit FROM events),
u AS (SELECT *, coalesce((hit <> lag(hit) OVER (PARTITION BY event_type ORDER BY event_id))::INT, 1) AS turn FROM e),
g AS (SELECT event_type, count(*)::BIGINT AS n, sum(hit)::BIGINT AS hits, sum(turn)::BIGINT AS runs FROM u GROUP BY 1),
z AS (SELECT *, {runs("n", "hits", "runs")} AS z FROM g)
SELECT event_type, n, hits, runs, round(z, 8) AS z, CASE WHEN z IS NOT NULL THEN round({survival("z")}, 8) END AS p FROM z""",
    "query_full": f"""WITH {FULL},
{HIST},
{ANI},
{patchy("tk", "id", "r")}
SELECT ani.sample, target, {_R8(("c1", "containment1"), ("c2", "containment2"), ("c10", "containment10"), *_INTERVALS, ("ani_est", "ani_est"), ("z", "patchiness_z"))},
  CASE WHEN z IS NOT NULL THEN round({survival("z")}, 8) END AS patchiness_p, h1 AS containment1_hits, h2 AS containment2_hits, h10 AS containment10_hits,
  med AS median_nz_abundance, ani.n AS target_kmers, target_length, sample_seqs, sample_bases
FROM ani LEFT JOIN pz ON pz.sample = ani.sample AND pz.id = ani.id""",
    "sample_stats": f"WITH r AS (SELECT source AS sample, {dna('text')} AS seq FROM documents)\nSELECT sample, count(*)::BIGINT AS sample_seqs, sum(length(seq))::BIGINT AS sample_bases FROM r GROUP BY 1",
    "limit_bases": f"""WITH r AS (SELECT source AS sample, doc_id AS seq_id, length({dna("text")}) AS length FROM documents),
b AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY sample ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT sample, seq_id, length::INT AS length FROM b WHERE before < 20000""",
    "group_index": f"WITH {MERGED}\nSELECT DISTINCT kmer, g::INT AS group_idx FROM mk",
    "group_unique": f"WITH {MERGED},\nx AS (SELECT DISTINCT kmer, g FROM mk),\ny AS (SELECT *, count(*) OVER (PARTITION BY kmer) AS c FROM x)\nSELECT g::INT AS group_idx, count(*)::BIGINT AS kmers, count(*) FILTER (c = 1)::BIGINT AS unique_kmers FROM y GROUP BY 1",
    "classify_discriminatory": f"WITH {classified(BY_SOURCE, 'gd')}\nSELECT * FROM ps",
    "classify_per_seq": f"WITH {classified(BY_SOURCE)}\nSELECT * FROM ps",
    "classify_rel_threshold": f"WITH {classified(BY_SOURCE, abs_threshold=2, rel=0.05)}\nSELECT * FROM ps",
    "classify_abs0": f"WITH {classified(BY_SOURCE, abs_threshold=0)}\nSELECT * FROM ps",
    "classify_summary": f'WITH {classified(BY_SOURCE)},\n{SUMMARY}\nSELECT sample, "group", seqs, bases, {_R8(("seqs_pct", "seqs_pct"), ("bases_pct", "bases_pct"))} FROM su',
    "classify_summary_order": f'WITH {classified(BY_SOURCE)},\n{SUMMARY}\nSELECT sample, row_number() OVER (PARTITION BY sample ORDER BY seqs_pct DESC, i)::BIGINT AS rank, "group" FROM su',
    "classify_rel_exact": f"WITH {classified(BY_SOURCE, rel=1 / 3)}\nSELECT * FROM ps",
    "lenhist": f"WITH {classified(BY_SOURCE)},\n{lenhist('bu')}\nSELECT * FROM lh",
    "lenhist_all": f"WITH {ALL_TURNS}\nSELECT * FROM lh",
    "lenhist_bins": f"{_BINS}\nSELECT sample, bin, n, round(density, 8) AS density FROM b",
    "lenhist_bins_range": f"{_BINS}\nSELECT sample, bin, n, round(density, 8) AS density FROM b WHERE bin BETWEEN 250 AND 3000 AND density BETWEEN 0.004 AND 0.5",
    "lenhist_order": f"WITH {classified(BY_SOURCE)},\n{lenhist('bu')},\ng AS (SELECT *, CASE \"group\" WHEN 'ambiguous' THEN 4 WHEN 'unclassified' THEN 5 ELSE substr(\"group\", 6)::INT END AS i FROM lh)\nSELECT sample, row_number() OVER (PARTITION BY sample ORDER BY i, length)::BIGINT AS rank, \"group\", length FROM g",
    "kde": f"""WITH {ALL_TURNS},
b AS (SELECT sample, length, sum(count)::BIGINT AS w FROM lh GROUP BY ALL),
f AS (SELECT sample, sum(w) AS n, min(length) AS lo, max(length) AS hi, sum(w * length) AS s1, sum(w * length * length) AS s2 FROM b GROUP BY 1),
g AS (SELECT sample, lo, hi, sqrt((s2 - s1::DOUBLE * s1 / n) / (n - 1)) * pow(n::DOUBLE, -0.2) AS h FROM f WHERE n > 1 AND lo < hi),
p AS (SELECT *, i, lo + (hi - lo) * i / 49.0::DOUBLE AS x FROM g, range(50) q(i))
SELECT p.sample, p.i::INT AS i, round(p.x, 6) AS x, round(sum(b.w * exp(-((p.x - b.length) / p.h) * ((p.x - b.length) / p.h) / 2)) / (p.h * sqrt(2 * pi())), 6) AS density FROM p JOIN b ON b.sample = p.sample GROUP BY p.sample, p.i, p.x, p.h""",
    "kde_range": f"""WITH {ALL_TURNS},
b AS (SELECT sample, length, sum(count)::BIGINT AS w FROM lh WHERE length BETWEEN 50 AND 400 GROUP BY ALL),
f AS (SELECT sample, sum(w) AS n, min(length) AS lo, max(length) AS hi, sum(w * length) AS s1, sum(w * length * length) AS s2 FROM b GROUP BY 1),
g AS (SELECT sample, lo, hi, 30.0::DOUBLE AS h FROM f WHERE n > 1 AND lo < hi),
p AS (SELECT *, i, lo + (hi - lo) * i / 19.0::DOUBLE AS x FROM g, range(20) q(i))
SELECT p.sample, p.i::INT AS i, round(p.x, 6) AS x, round(sum(b.w * exp(-((p.x - b.length) / p.h) * ((p.x - b.length) / p.h) / 2)) / (p.h * sqrt(2 * pi())), 6) AS density FROM p JOIN b ON b.sample = p.sample GROUP BY p.sample, p.i, p.x, p.h""",
    "unpivot_decay": f"""WITH {FULL},
{TOTALS}
SELECT target, sample, threshold::INT AS threshold, round(c, 8) AS containment FROM (
  SELECT target, sample, 1 AS threshold, c1 AS c FROM tot UNION ALL SELECT target, sample, 2, c2 FROM tot UNION ALL SELECT target, sample, 10, c10 FROM tot)""",
    "concat_reports": f"""SELECT lang AS sample, count(*)::BIGINT AS sample_seqs, sum(length({dna("text")}))::BIGINT AS sample_bases, NULL::VARCHAR AS run FROM documents GROUP BY 1
UNION ALL SELECT source, count(*)::BIGINT, sum(length({dna("text")}))::BIGINT, 'source' FROM documents GROUP BY 1""",
    "short_names": f"""WITH {FULL},
{TOTALS}
SELECT sample, target, CASE WHEN target = 'TOTAL' THEN 'All targets' WHEN target LIKE '% %' THEN substr(target, instr(target, ' ') + 1) ELSE target END AS display_name,
  CASE WHEN med > 0 THEN 'med(abund): ' || round_even(med, 0)::BIGINT ELSE '' END AS depth_label FROM tot""",
    "plot_totals": f"WITH {FULL},\n{TOTALS}\nSELECT sample, target, n AS target_kmers, h1 AS containment1_hits, round(c1, 8) AS containment1 FROM tot WHERE is_total AND sample IN ('en', 'de')",
    "plot_prep": f"""WITH {FULL},
p AS (SELECT * FROM c WHERE sample IN ('en', 'de'))
SELECT sample, target, (dense_rank() OVER (ORDER BY id) - 1)::INT AS target_idx, round(c1, 8) AS containment1, (SELECT count(DISTINCT sample) FROM p)::BIGINT AS n_samples FROM p""",
    "lenhist_sample_reads": f"WITH {ALL_TURNS}\nSELECT sample, \"group\", length, count, sum(count) OVER (PARTITION BY sample)::BIGINT AS sample_reads FROM lh",
    "target_intersection": f"WITH t AS (SELECT item_id AS id, {dna('text')} AS seq FROM benchmark),\n{mers('tk', 't', 7, 3)}\nSELECT kmer FROM tk WHERE id % 4 = 0 INTERSECT SELECT kmer FROM tk WHERE id % 4 = 1",
    "group_masks": f"WITH t AS (SELECT item_id AS id, {dna('text')} AS seq FROM benchmark),\n{mers('tk', 't', 15, 7)},\nx AS (SELECT DISTINCT kmer, (id * 7) % 100 AS g FROM tk)\nSELECT kmer, count(*)::BIGINT AS n_groups, string_agg(g::VARCHAR, ',' ORDER BY g) AS groups FROM x GROUP BY 1",
    "index_packed": f"WITH t AS (SELECT item_id AS id, 'item ' || item_id AS target, {dna('text')} AS seq FROM benchmark),\n{mers('tk', 't', 61)}\nSELECT target, pos AS position, kmer FROM tk JOIN t USING (id)",
    "index_buckets": f"WITH {MERGED},\n{READS},\nx AS (SELECT DISTINCT kmer, g FROM mk)\nSELECT rk.id AS seq_id, g::INT AS group_idx, count(*)::BIGINT AS n FROM rk JOIN x USING (kmer) GROUP BY ALL",
    "index_packed_classify": f"WITH {classified(BY_SOURCE)}\nSELECT * FROM ps",
    "index_roundtrip": f"WITH {TARGETS}\n{DUMP_T}",
    "index_info": f"""WITH {MERGED},
x AS (SELECT DISTINCT kmer, g FROM mk)
SELECT 'group' || g AS name, count(x.kmer)::BIGINT AS n_kmers, 'classify' AS kind, {K} AS k, {S} AS s, 4::BIGINT AS n_names, (SELECT count(*) FROM x)::BIGINT AS total_kmers FROM (SELECT unnest(range(4)) AS g) LEFT JOIN x USING (g) GROUP BY g""",
    "format_bp": f"""WITH o AS (SELECT o_orderkey, trunc(o_totalprice * o_orderkey)::BIGINT AS n FROM orders)
SELECT o_orderkey, {_format("n", "", "n || 'bp'", "")} AS bp, {_format("n", " ", "n || ' bp/s'", "/s")} AS rate FROM o""",
}
