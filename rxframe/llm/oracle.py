"""DuckDB SQL for the operators that SQL can express."""

from rxframe.llm import licenses


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    """The canonical form of a license text; spellings are the same fixed values."""
    low = f"lower(coalesce({text}, ''))"
    body = f"CASE WHEN regexp_matches({low}, 'copyright|\\(c\\)|©|rights reserved') THEN regexp_replace({low}, {_quoted(licenses.COPYRIGHT)}, '', 'g') ELSE {low} END"
    out = f"' ' || regexp_replace({body}, '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    for found, wanted in licenses.SPELLINGS:
        out = f"regexp_replace({out}, '([ \\n]){found}', '\\1{wanted}', 'g')"
    return out


_WHOLE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_KNOWN = ", ".join(f"({_quoted(name)}, {_quoted(body)})" for name, body in licenses.KNOWN)
#: Base 32 letters of each 5 hexadecimal digits of a SHA-1.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {shift} & 31)::INTEGER + 1, 1)"
    for g in range(8)
    for shift in (15, 10, 5, 0)
)
#: The smallest id reachable over ``links`` (a, b, both ways) from each id of ``d``.
_REACH = """r AS (
  SELECT id, id AS c FROM d UNION SELECT links.b, r.c FROM r JOIN links ON links.a = r.id
), components AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)"""

ORACLE = {
    "op4_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT)
      - CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target FROM f
), q AS (
  SELECT d.*, source_size, target, r.round, md5('mix/' || r.round || '/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1), (2)) r(round)
  WHERE size > 0 AND r.round <= floor(target / source_size)
), v AS (
  SELECT *, (round * source_size + CAST(sum(size) OVER (
      PARTITION BY source, round ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS BIGINT)) / target AS finish FROM q
), e AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, round, key, size ROWS UNBOUNDED PRECEDING) AS stop FROM v
), k AS (
  SELECT doc_id, source, CAST(sum(size) AS BIGINT) AS taken FROM e
  WHERE stop <= (SELECT sum(size) FROM d) GROUP BY doc_id, source
)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(k.taken, 0) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN k ON k.doc_id = d.doc_id AND k.source IS NOT DISTINCT FROM d.source
""",
    "op10_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
  text_sha256
FROM d
""",
    "op3_license_scan": f"""
WITH known AS (
  SELECT DISTINCT license, {_WHOLE.format("form")} AS form FROM (SELECT license, {_canonical("body")} AS form FROM (VALUES {_KNOWN}) k(license, body))
), d AS (
  SELECT doc_id, {_canonical("text")} AS form FROM documents
), n AS (
  SELECT doc_id, list_sort(list(DISTINCT license)) AS names
  FROM (SELECT doc_id, trim(unnest(string_split(form, chr(10)))) AS line FROM d) JOIN known ON known.form = line GROUP BY doc_id
), w AS (
  SELECT doc_id, list_sort(list(DISTINCT license)) AS names FROM d JOIN known ON known.form = {_WHOLE.format("d.form")} GROUP BY doc_id
)
SELECT doc_id, CASE WHEN {_WHOLE.format("form")} <> '' THEN sha256({_WHOLE.format("form")}) END AS text_digest,
  coalesce(array_to_string(w.names, ','), '') AS licenses, coalesce(array_to_string(n.names, ','), '') AS notices
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN w USING (doc_id)
""",
    "op5_minhash_near_dedup": rf"""
WITH RECURSIVE t AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), d AS (
  SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM t
), x AS (SELECT id, len(s) AS n, unnest(s) AS shingle FROM d
), links AS (
  SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.id <> b.id
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), {_REACH}
SELECT id AS doc_id, len(s) AS n_shingles, component_id, id = component_id AS kept FROM d JOIN components USING (id)
""",
    "op7_warc": f"""
WITH d AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages)
SELECT page_id, strlen(html) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = min(page_id) OVER (PARTITION BY h) THEN 'response' ELSE 'revisit' END AS record_type,
  nullif(min(page_id) OVER (PARTITION BY h), page_id) AS refers_to
FROM d
""",
    "op9_embedding_near_dedup": f"""
WITH RECURSIVE d AS (
  SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings
), k AS (
  SELECT * FROM d WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0 AND label IS NOT NULL
), links AS (
  SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.label = b.label AND a.id <> b.id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.93
), {_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = d.id) AS n_links, component_id, id = component_id AS kept
FROM d JOIN components USING (id)
""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS y,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS a, b.id AS b, a.y = b.y AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id
), p AS (
  SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5
)
SELECT p.a AS anchor_id, p AS positive_id, row_number() OVER (PARTITION BY p.a, p ORDER BY s DESC, b) AS rank,
  b AS negative_id, ps AS positive_score, s AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT same AND 80 * ps <= 100 * s AND 100 * s <= 100 * ps
QUALIFY rank <= 5""",
}
