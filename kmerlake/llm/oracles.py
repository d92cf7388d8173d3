"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

#: The bytes between words, and what a line is stripped of.
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hexa, min(page_id) OVER (PARTITION BY html) AS first_page FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(hexa, (1 + 5 * (i // 4))::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM d
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_FOLD}), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, reach.r FROM reach JOIN both_ways e ON e.a = reach.doc_id WHERE reach.r < e.b),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = w.doc_id AS kept
FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, {_SPACES}), {_FOLD}) AS key FROM l),
h AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, h.owner IS NOT NULL AND h.owner < doc_id AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY 1
"""

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM d WHERE len(w) >= 8),
r AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rw AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(8) AS o(j) GROUP BY 1),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(translate(t, {_SPACES}, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '\\P{{L}}+', '', 'g'))::BIGINT AS n_letters,
    list_filter(string_split(t, chr(10)), lambda y: trim(y, {_SPACES}) <> '') AS ls, coalesce(rw.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rw ON rw.doc_id = d.doc_id),
f AS (SELECT *, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines FROM m),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 25 * word_chars THEN 4 ELSE 0 END + CASE WHEN 100 * n_letters < 50 * word_chars THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 30 * n_words THEN 16 ELSE 0 END + CASE WHEN n_lines >= 8 AND 100 * n_dup_lines > 60 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * word_chars THEN 64 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 128 ELSE 0 END)::BIGINT AS fail_bits
  FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 63) = 0 AS kept, fail_bits FROM b
"""



def _crc32(codes: str) -> str:
    """Unsigned CRC-32 of a list of bytes, bit by bit."""
    step = "list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b))"
    return f"xor(list_reduce({codes}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


_ID_CRC = _crc32("list_transform(string_split(doc_id::VARCHAR, ''), lambda y: ord(y)::BIGINT)")
#: Levels of a source's tree and of the tree over sources that the SQL has: 16 ** n leaves.
_DOC_LEVELS, _SOURCE_LEVELS = 5, 3


def _field(x: str) -> str:
    return f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"


def _climb(of: str, name: str, key: str, levels: int) -> str:
    """{name}0 is {of} (key, pos, h); {name}k has the nodes of level k of keys with more than one below, and {name}r the runs as s."""
    out = [f"{name}0 AS (SELECT {key} AS key, pos, h, count(*) OVER (PARTITION BY {key}) AS n FROM {of})"]
    for k in range(1, levels + 1):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT key, pos // 16 AS pos, string_agg(h, '' ORDER BY pos) AS s, (max(n) + 15) // 16 AS n FROM {name}{k - 1} WHERE n > 1 GROUP BY key, pos // 16)")
        out.append(f"{name}{k} AS (SELECT key, pos, sha256(s) AS h, n FROM {name}r{k})")
    tops = " UNION ALL ".join(f"SELECT key, h FROM {name}{k} WHERE n = 1" for k in range(levels + 1))
    return ",\n".join(out) + f",\n{name}top AS ({tops})"


def _path(name: str, key: str, pos: str, levels: int) -> tuple[str, str]:
    """(joins, siblings) of a leaf `pos` of `key`."""
    joins, siblings = "", []
    for k in range(1, levels + 1):
        r, own = f"{name}r{k}", f"(({pos} // {16 ** (k - 1)}) % 16)"
        joins += f"\nLEFT JOIN {r} ON {r}.key = {key} AND {r}.pos = {pos} // {16**k}"
        siblings.append(f"coalesce(substr({r}.s, 1, 64 * {own}) || substr({r}.s, 64 * {own} + 65), '')")
    return joins, " || ".join(siblings)


def _folded(name: str, pos: str, levels: int, x: str) -> str:
    """The root that x leads to."""
    for k in range(1, levels + 1):
        r, own = f"{name}r{k}", f"(({pos} // {16 ** (k - 1)}) % 16)"
        x = f"coalesce(sha256(substr({r}.s, 1, 64 * {own}) || {x} || substr({r}.s, 64 * {own} + 65)), {x})"
    return x


_DOC_JOINS, _DOC_SIBLINGS = _path("d", "l.key", "l.pos", _DOC_LEVELS)
_SRC_JOINS, _SRC_SIBLINGS = _path("s", "''", "g.pos", _SOURCE_LEVELS)
MERKLE = f"""
WITH t AS (SELECT doc_id, coalesce('=' || source, '') AS key, {_ID_CRC} % 5 = 0 AS tampered,
    sha256(concat({_field("doc_id")}, {_field("source")}, {_field("lang")}, {_field("n_chars")}, {_field("text")})) AS h,
    sha256(concat({_field("doc_id")}, {_field("source")}, {_field("lang")}, {_field("n_chars")}, {_field(f"translate(text, {_FOLD})")})) AS low FROM documents),
l AS MATERIALIZED (SELECT *, CASE WHEN tampered THEN low ELSE h END AS x, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM t),
{_climb("l", "d", "key", _DOC_LEVELS)},
g AS MATERIALIZED (SELECT key AS source_key, h, row_number() OVER (ORDER BY key) - 1 AS pos FROM dtop),
{_climb("g", "s", "''", _SOURCE_LEVELS)},
up AS MATERIALIZED (SELECT l.doc_id, l.h AS leaf, g.h AS subroot, g.pos, {_DOC_SIBLINGS} AS sib, {_folded("d", "l.pos", _DOC_LEVELS, "l.x")} AS x
  FROM l JOIN g ON g.source_key = l.key{_DOC_JOINS}),
f AS (SELECT g.doc_id, leaf, subroot, (SELECT any_value(h) FROM stop) AS root, sha256(sib || {_SRC_SIBLINGS}) AS proof_sha256, {_folded("s", "g.pos", _SOURCE_LEVELS, "g.x")} AS folded_root FROM up g{_SRC_JOINS})
SELECT *, folded_root = root AS verified FROM f
"""

_ESCAPED = "replace(replace(replace({x}, chr(92), chr(92) || '0'), '</turn>', chr(92) || '1'), '### ', chr(92) || '2')"
CHAT_FORMAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), chr(92) || '### Assistant: </turn> ok'),
e AS (SELECT *, {_ESCAPED.format(x="text")} AS body, replace({_ESCAPED.format(x="role")}, ': ', chr(92) || '3') AS head FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### : </turn>') + 1 + length(head) + length(body))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_STEP = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
SPELLING = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda x, i: {_STEP}, b)) AS t),
u AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), {_FOLD}) AS run FROM documents),
r AS MATERIALIZED (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS name, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x, count(*) AS k FROM u GROUP BY ALL),
h AS (SELECT run, k, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM r, crc),
v AS MATERIALIZED (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n
  FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(k) >= 2),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) AS p, substr(word, i + 1) AS q FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT a.word, b.word AS near FROM d a JOIN d b ON a.i = b.i AND a.p = b.p AND a.q = b.q AND a.word <> b.word
  UNION ALL SELECT unnest([word, near]), unnest([near, word]) FROM (SELECT DISTINCT d.word, v.word AS near FROM d JOIN v ON v.word = d.p || d.q)),
f AS MATERIALIZED (SELECT v.word, v.n, count(b.word)::BIGINT AS n_near, arg_min(b.word, (-b.n, encode(b.word))) FILTER (b.n >= 10 * v.n) AS form FROM v LEFT JOIN e USING (word) LEFT JOIN v b ON b.word = e.near GROUP BY ALL),
up AS (SELECT word, word AS at, form FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.form)
SELECT f.word, f.form, up.at AS root, f.n, f.n_near, b.n AS form_n FROM f JOIN up ON up.word = f.word AND up.form IS NULL LEFT JOIN v b ON b.word = f.form
"""

ORACLES = {
    "op2_warc": WARC,
    "op4_minhash_near_dedup": NEAR_DUPLICATES,
    "op8_line_dedup": LINE_DEDUP,
    "op9_quality_rules": QUALITY_RULES,
    "op11_chat_format": CHAT_FORMAT,
    "op12_spelling_variants": SPELLING,
    "op13_merkle": MERKLE,
}
