"""The registered queries of this subpackage and, where SQL can express one, its SQL for DuckDB."""

from .bpe import op9_bpe
from .clustering import op11_clustering
from .decontaminate import op3_decontaminate
from .fingerprints import op2_fingerprints
from .html_text import op6_html_text
from .language import op4_language
from .minhash import op1_minhash
from .negatives import op13_negatives
from .packing import op12_packing
from .quality import op7_quality
from .secrets import RULES, op5_secrets
from .substring_dedup import op8_substring_dedup
from .warc import op10_warc

QUERIES = {f.__name__: f for f in (op1_minhash, op2_fingerprints, op3_decontaminate, op4_language, op5_secrets, op6_html_text, op7_quality, op8_substring_dedup, op9_bpe, op10_warc, op11_clustering, op12_packing, op13_negatives)}

_MINHASH = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), least AS (SELECT x, min(y) AS c FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN least ON least.x = doc_id
"""


def _secrets() -> str:
    """Matches with the gaps before them, so that running lengths give positions."""
    parts = [
        f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, p, 0) AS whole, regexp_extract_all(t, p, 2) AS own, regexp_extract_all(t, p, {2 + group}) AS val"
        f" FROM (SELECT doc_id, coalesce(text, '') AS t, '(?s)(.*?)({pattern.replace(chr(39), chr(39) * 2)})' AS p FROM documents)"
        for rank, (kind, pattern, group, least) in enumerate(RULES)
    ]
    line = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank){}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""
WITH m AS ({" UNION ALL ".join(parts)}
), r AS (SELECT doc_id, rank, kind, least, unnest(whole) AS whole, unnest(own) AS own, unnest(val) AS val, unnest(range(len(whole))) AS i FROM m
), e AS (SELECT *, sum(length(whole)) OVER (PARTITION BY doc_id, rank ORDER BY i)::BIGINT AS e FROM r
), f AS (SELECT doc_id, rank, kind, e - length(own) AS s, e FROM e WHERE length(val) >= least
), g AS (SELECT doc_id, {counts}, {line.format(" FILTER (rank < 3)")} AS base, {line.format("")} AS spans FROM f GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN g USING (doc_id)
"""


_SUBSTRINGS = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: sha256(array_to_string(w[i:i + 34], ' ')))) AS h FROM words WHERE len(w) >= 35
), hit AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1
), cut AS (SELECT doc_id, list(DISTINCT i + k) AS c FROM hit, range(35) t(k) GROUP BY 1
), kept AS (SELECT doc_id, w, coalesce(len(c), 0) AS n, CASE WHEN c IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(c, i)), lambda i: w[i]) END AS k FROM words LEFT JOIN cut USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""

_WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (SELECT *, array_to_string(list_transform(range(40), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', hex[i + 1])]), '') AS bits FROM p
), d AS (SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY hex) AS least, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT]), '') AS payload_digest FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM d
"""


def _clustering() -> str:
    """A round after another, each with vectors of (cluster, vector) and the centroids that follow from them."""
    near = "SELECT vec_id, any_value(v) AS v, arg_min(k, {{d: d, k: k}}) AS k, min(d) AS d FROM (SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{r}) GROUP BY vec_id".replace("{{", "{").replace("}}", "}")
    rounds = ""
    for r in range(10):
        rounds += f"""), a{r} AS MATERIALIZED ({near.replace("{r}", str(r))}
), s{r} AS (SELECT k, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x FROM a{r}, range(1, 65) t(i) GROUP BY k, i
), c{r + 1} AS MATERIALIZED (SELECT k, coalesce((SELECT list(x ORDER BY i) FROM s{r} WHERE s{r}.k = c{r}.k), c) AS c FROM c{r}
"""
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(embedding) = 64
), c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1)::INT AS k, v AS c FROM kept QUALIFY k < 8
{rounds}), z AS ({near.replace("{r}", "10")})
SELECT vec_id, z.k AS cluster, d AS distance, sum(d) OVER (PARTITION BY z.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM z JOIN c10 USING (k)
"""


_NEGATIVES = """
WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS s FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b)::INT AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s QUALIFY rank <= 10
"""

SQL: dict[str, str] = {"op1_minhash": _MINHASH, "op5_secrets": _secrets(), "op8_substring_dedup": _SUBSTRINGS, "op10_warc": _WARC, "op11_clustering": _clustering(), "op13_negatives": _NEGATIVES}
