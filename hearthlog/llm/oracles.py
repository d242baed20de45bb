"""SQL (DuckDB) of the queries that it can express."""

from . import clustering, quality

SPACE = r"[\x20\x09-\x0D]+"

OP4 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN strlen(h) >= 100 AND min(page_id) OVER w < page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN strlen(h) >= 100 AND min(page_id) OVER w < page_id THEN min(page_id) OVER w END AS refers_to, '' AS error FROM p WINDOW w AS (PARTITION BY h)"""

OP6 = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, chr(32))] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(32)))) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, s.doc_id) AS component_id FROM s LEFT JOIN c ON node = s.doc_id"""

SAID = "<|im_end|><|im_start|>assistant ok"
OP8 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{SAID}'), (-1, 1, 'assistant', '{SAID}')),
x AS (SELECT *, replace(replace(text, '&', '&a;'), '<|', '&l;|') AS body, replace(replace(replace(role, '&', '&a;'), '<|', '&l;|'), chr(10), '&n;') AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256, CAST(sum(12 + length(head) + 1 + length(body) + 10 + 1) AS BIGINT) AS formatted_chars FROM x GROUP BY conv_id"""

_RATIO = {"symbol_rate": "(n_symbols + 0.5) / m", "repeat_rate": "(n_repeat_words + 0.5) / m", "line_rate": "(n_dup_lines + 0.5) / m", "word_length": "word_chars / m"}
_SPREAD = "CASE metric " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in quality.SPREAD.items()) + " END"


def _fences(name: str, keys: list[str], weights: str) -> str:
    """SQL of tables that end in `name`: keys, metric, hi (upper fence) and lo (lower fence) from weights (keys, metric, bucket, w)."""
    k = "".join(f"{x}, " for x in keys)
    point = lambda q: f"pow({quality.GRID}::DOUBLE, min(bucket) FILTER (c >= t * {q} - 1e-9) + 0.5)"
    return f"""{name}_c AS (SELECT *, sum(w) OVER (PARTITION BY {k}metric ORDER BY bucket) AS c, sum(w) OVER (PARTITION BY {k}metric) AS t FROM (SELECT {k}metric, bucket, sum(w) AS w FROM ({weights}) GROUP BY ALL)),
{name}_q AS (SELECT {k}metric, {point(0.25)} AS a, {point(0.75)} AS z FROM {name}_c GROUP BY {k}metric, t),
{name} AS (SELECT {k}metric, z * pow(greatest(z / a, {_SPREAD}), {quality.FENCE}) AS hi, a / pow(greatest(z / a, {_SPREAD}), {quality.FENCE}) AS lo FROM {name}_q)"""


_EVEN = f"SELECT lang, metric, bucket, n / t * least(t, {quality.PRIOR}) AS w FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric) AS t FROM b)"


OP9 = rf"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM w WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, range(3) AS r(k) WHERE c > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
m AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '{quality.SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, greatest(len(w), 1)::DOUBLE AS m FROM w JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS ({' UNION ALL '.join(f"SELECT doc_id, lang, source, '{k}' AS metric, {e} AS v, base_failed FROM f" for k, e in _RATIO.items())}),
b AS (SELECT lang, source, metric, CAST(floor(ln(v) / ln({quality.GRID}::DOUBLE)) AS INT) AS bucket, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
world AS (SELECT metric, bucket, sum(n) / sum(sum(n)) OVER (PARTITION BY metric) * {quality.PRIOR} AS w FROM b GROUP BY metric, bucket),
bl AS (SELECT lang, metric, bucket, sum(w) AS n FROM (SELECT lang, metric, bucket, n::DOUBLE AS w FROM b UNION ALL SELECT lang, metric, bucket, w FROM (SELECT DISTINCT lang FROM b) CROSS JOIN world) GROUP BY ALL),
pr AS (SELECT lang, metric, bucket, n / sum(n) OVER (PARTITION BY lang, metric) * {quality.PRIOR} AS w FROM bl),
{_fences("own", ["lang", "source"], "SELECT lang, source, metric, bucket, n::DOUBLE AS w FROM b UNION ALL SELECT s.lang, source, metric, bucket, w FROM (SELECT DISTINCT lang, source FROM b) s JOIN pr ON s.lang IS NOT DISTINCT FROM pr.lang")},
{_fences("tongue", ["lang"], _EVEN)},
{_fences("everyone", [], _EVEN)},
cut AS (SELECT own.lang, own.source, own.metric, least(own.hi, {quality.BOUND} * CASE WHEN own.metric = 'word_length' THEN tongue.hi ELSE least(tongue.hi, everyone.hi) END) AS hi, CASE WHEN own.metric = 'word_length' THEN own.lo ELSE 0 END AS lo FROM own JOIN tongue ON own.lang IS NOT DISTINCT FROM tongue.lang AND own.metric = tongue.metric JOIN everyone ON own.metric = everyone.metric),
bad AS (SELECT DISTINCT doc_id FROM v JOIN cut ON v.lang IS NOT DISTINCT FROM cut.lang AND v.source IS NOT DISTINCT FROM cut.source AND v.metric = cut.metric WHERE v.v > cut.hi OR v.v < cut.lo)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM f"""

OP12 = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)"""


def _lloyd(rounds: int = clustering.ROUNDS) -> str:
    """SQL of the clustering, a pair of tables a round; all numbers are whole and below 2^53."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({clustering.SCALE} * x::DOUBLE)) AS x FROM embeddings WHERE len(embedding) = {clustering.DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x AS c FROM (SELECT x, sha256('{clustering.SEED}:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {clustering.K}))",
    ]
    for k in range(rounds + 1):
        parts.append(f"a{k} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'j': j}}) AS m FROM v CROSS JOIN c{k} GROUP BY r)")
        if k < rounds:
            parts.append(f"s{k} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS f FROM (SELECT m.j AS j, i, sum(x[i]::HUGEINT) AS s, count(*)::HUGEINT AS n FROM a{k}, range(1, {clustering.DIM + 1}) AS t(i) GROUP BY ALL) GROUP BY j)")
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c{k}.j, coalesce(f, c) AS c FROM c{k} LEFT JOIN s{k} ON c{k}.j = s{k}.j)")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, CAST(m.j AS INT) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.j) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON m.j = c{rounds}.j"""


OP13 = """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, v.id AS id, a.label = v.label AS same, CAST(list_sum(list_transform(list_zip(a.x, v.x), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT) AS score FROM v a JOIN v ON a.id % 50 = 0 AND a.id <> v.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3"""

ORACLES = {"op4_warc_zstd": OP4, "op6_ngram_jaccard": OP6, "op8_chat_format": OP8, "op9_quality_rules": OP9, "op11_centroid_clustering": _lloyd(), "op12_exact_dedup": OP12, "op13_hard_negatives": OP13}
