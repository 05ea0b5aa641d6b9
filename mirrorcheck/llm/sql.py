"""SQL of the text operators whose results SQL can express."""

from __future__ import annotations

from .common import LOWER, UPPER, WORD
from .licenses import PHRASES, TEMPLATES, template_words, window_length
from .secrets import BASE, OPEN


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_quoted, items)) + "]"


LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

SHARDS = """
WITH entries AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS e),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
digits AS (SELECT r, list_transform(string_split(hex(encode(t)), ''), lambda x: instr('0123456789ABCDEF', x) - 1) AS h, octet_length(encode(t)) AS n FROM d),
sums AS (SELECT r, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(n), lambda i: h[2 * i + 1] * 16 + h[2 * i + 2])),
    lambda c, b: xor(c >> 8, e[(xor(c, b) & 255) + 1]))) AS crc FROM digits, entries),
scores AS (SELECT r, i, -ln((CAST('0x' || substr(md5(doc_id::VARCHAR || ':' || i::VARCHAR), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) AS score
    FROM d, range(41) s(i)),
best AS (SELECT r, arg_min(i, score) FILTER (WHERE i < 40) AS shard, arg_min(i, score) AS grown FROM scores GROUP BY r)
SELECT doc_id, CAST(n + 16 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id::VARCHAR), doc_id, n, crc) - 1 AS slot, CAST(grown AS INT) AS grown_shard
FROM d JOIN sums USING (r) JOIN best USING (r)"""


def _span_rows(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    extra = " AND regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[a-z]') AND regexp_matches(v[i], '[A-Z]')" if kind == "open" else ""
    p = _quoted(pattern)
    return f"""SELECT r, {rank} AS rank, '{kind}' AS kind, v[i] AS value, length(h[i]) AS size,
    coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT r, h, v, g, unnest(range(1, len(h) + 1)) AS i
    FROM (SELECT r, regexp_extract_all(t, {p}, 0) AS h, regexp_extract_all(t, {p}, {group}) AS v, string_split_regex(t, {p}) AS g FROM d))
  WHERE length(v[i]) >= {least}{extra}"""


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, concat_ws('/', source, lang) AS repository, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join(_span_rows(i, *b) for i, b in enumerate((*BASE, OPEN)))}),
classes AS (SELECT value, CASE WHEN count(DISTINCT source) >= 3 THEN 'example' WHEN count(DISTINCT source) = 1 THEN 'live' END AS class
  FROM hits JOIN d USING (r) GROUP BY value),
spans AS (SELECT r, rank, kind, start, start + size AS stop FROM hits WHERE kind <> 'open'
  UNION SELECT r, CASE class WHEN 'example' THEN 3 ELSE 4 END, class, start, start + size FROM hits JOIN classes USING (value) WHERE class IS NOT NULL),
texts AS (SELECT *, concat_ws(':', kind, CAST(start AS BIGINT)::VARCHAR, CAST(stop AS BIGINT)::VARCHAR) AS said FROM spans)
SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
  coalesce(string_agg(said, ',' ORDER BY start, rank, stop), '') AS spans
FROM d LEFT JOIN texts USING (r) GROUP BY r, doc_id"""


def _phrase(words: list[str], label: str) -> str:
    return f"list_transform(list_filter(range(len(w)), lambda i: w[i + 1:i + {len(words)}] = {_list(words)}), lambda i: struct_pack(at := i, label := '{label}'))"


_PLACES = ", ".join(_phrase(p.split(), label) for p, label in PHRASES)
_TEMPLATES = " UNION ALL ".join(f"SELECT {_quoted(name)} AS template, {_list(template_words(text))} AS tw, {window_length(text, 0.8)} AS size" for name, text in TEMPLATES)

LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {LOWERED} AS t FROM documents),
words AS (SELECT r, regexp_extract_all(t, '{WORD}') AS w FROM d),
places AS (SELECT r, len(w) AS n, flatten([{_PLACES}]) AS p FROM words),
templates AS ({_TEMPLATES}),
held AS (SELECT r, template, list_max(list_transform(range(len(w)), lambda i: len(list_intersect(w[i + 1:i + size], tw)))) / len(tw) AS c, ceil(0.8 * len(tw) - 1e-9) / len(tw) AS need
  FROM words, templates WHERE len(list_intersect(w, tw)) >= ceil(0.8 * len(tw) - 1e-9)),
best AS (SELECT r, list(DISTINCT template) AS names, max(c) AS c FROM held WHERE c >= need GROUP BY r)
SELECT doc_id, n AS n_words, CAST(len(p) AS BIGINT) AS n_base, list_min(list_transform(p, lambda x: x.at)) AS first_word, list_max(list_transform(p, lambda x: x.at)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), coalesce(names, [])))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM d JOIN places USING (r) LEFT JOIN best USING (r)"""

CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM benchmark),
windows AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1:i + 10], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT r, n, i, array_to_string(w[i + 1:i + n], ' ') AS phrase
  FROM (SELECT r, n, w, unnest(range(len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT r, n, i, item_id FROM places JOIN windows USING (n, phrase)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)"""

COMPONENTS = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
s AS (SELECT DISTINCT r, g FROM (SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' ')) END) AS g FROM d)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y USING (g) GROUP BY x.r, y.r)
  JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT r AS a, r AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN d ON d.r = b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN least ON a = d.r"""


# CRC-32 in SQL: the table of the reversed polynomial, and a checksum over the bytes of a text
CRC_TABLE = """(SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS e)"""


def _crc(text: str) -> str:
    digit = "instr('0123456789ABCDEF', substr(hex(encode({0})), CAST(2 * i + {1} AS BIGINT), 1)) - 1"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ({digit.format(text, 1)}) * 16 + {digit.format(text, 2)})"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {octets}), lambda c, b: xor(c >> 8, e[(xor(c, b) & 255) + 1])))"


def _said(*values: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in values) + ")"


MANIFEST = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, lang, {_said("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
    CASE WHEN {_crc("doc_id::VARCHAR")} % 7 = 0 THEN {_said("doc_id", "source", "lang", "(n_chars + 1)", "text")} END AS changed FROM documents, {CRC_TABLE}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
up(lang, lvl, i, n, h) AS (SELECT lang, 0, i, n, leaf FROM ranked
  UNION ALL SELECT lang, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY lang, lvl, i // 2, n),
subs AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top(lvl, i, n, h) AS (SELECT 0, i, n, subroot FROM subs
  UNION ALL SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lvl, i // 2, n),
low AS (SELECT r, k.lvl, (i >> k.lvl) % 2 = 0 AS after, lang, xor(i >> k.lvl, 1) AS want FROM ranked JOIN (SELECT DISTINCT lang AS l, lvl FROM up WHERE n > 1) k ON lang IS NOT DISTINCT FROM l),
high AS (SELECT r, k.lvl, (s.i >> k.lvl) % 2 = 0 AS after, xor(s.i >> k.lvl, 1) AS want FROM ranked q JOIN subs s ON q.lang IS NOT DISTINCT FROM s.lang, (SELECT DISTINCT lvl FROM top WHERE n > 1) k),
steps AS (SELECT r, low.lvl AS step, after, coalesce(h, '') AS h FROM low LEFT JOIN up ON up.lang IS NOT DISTINCT FROM low.lang AND up.lvl = low.lvl AND up.i = want
  UNION ALL SELECT r, 1000 + high.lvl, after, coalesce(h, '') FROM high LEFT JOIN top ON top.lvl = high.lvl AND top.i = want),
paths AS (SELECT r, list(struct_pack(h := h, after := after) ORDER BY step) AS p FROM steps GROUP BY r),
folded AS (SELECT q.*, coalesce(p, []) AS p, list_reduce(list_concat([struct_pack(h := coalesce(changed, leaf), after := false)], coalesce(p, [])),
  lambda a, s: struct_pack(h := CASE WHEN s.after THEN sha256(a.h || s.h) ELSE sha256(s.h || a.h) END, after := false)).h AS folded_root FROM ranked q LEFT JOIN paths USING (r))
SELECT doc_id, leaf, subroot, t.h AS root, sha256(coalesce(array_to_string(list_transform(p, lambda x: x.h), ''), '')) AS proof_sha256, folded_root, folded_root = t.h AS verified
FROM folded JOIN subs s ON folded.lang IS NOT DISTINCT FROM s.lang, (SELECT h FROM top WHERE n = 1) t"""

RESAMPLING = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents),
dw AS (SELECT r, unnest(w) AS w FROM d), bw AS (SELECT unnest(regexp_extract_all({LOWERED}, '{WORD}')) AS w FROM benchmark),
hashed AS (SELECT w, {_crc("w")} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), {CRC_TABLE}),
raw AS (SELECT b, count(*) AS n FROM dw JOIN hashed USING (w) GROUP BY b), aim AS (SELECT b, count(*) AS n FROM bw JOIN hashed USING (w) GROUP BY b),
totals AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s, (SELECT count(*) FROM bw)::DOUBLE AS t),
gains AS (SELECT raw.b, floor(1000 * ln((coalesce(aim.n, 0) + 1)::DOUBLE * (s + 10000) / ((raw.n + 1)::DOUBLE * (t + 10000)))) AS g FROM raw LEFT JOIN aim USING (b), totals),
means AS (SELECT r, floor(sum(g) / count(*)) AS weight FROM dw JOIN hashed USING (w) JOIN gains USING (b) GROUP BY r),
scores AS (SELECT doc_id, len(w) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0)
    + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN means USING (r)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= n * 10 // 100 THEN k END AS rank FROM ranked"""

NEAR_VECTORS = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
able AS (SELECT r, v FROM d WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT x.r AS a, y.r AS b FROM able x JOIN able y ON x.r <> y.r AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN d ON d.r = b GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN least ON least.a = r LEFT JOIN counts ON counts.a = r"""
