"""The SQL twin of each query of this folder that SQL can express, for DuckDB."""

ORACLES: dict[str, str] = {}

ORACLES["op1_exact_top_k"] = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         max(CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT)) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
  WHERE q.vec_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""


def _url_levels(levels: int = 6, many: int = 20, rare: int = 5) -> str:
    """The template tree, one level per pair of steps."""
    out = ["t0 AS MATERIALIZED (SELECT *, '' AS template, '' AS parent FROM typed)"]
    for n in range(levels):
        seg = f"segments[{n + 1}]"
        out.append(f"""
b{n} AS MATERIALIZED (SELECT host, template, {seg} AS s, sum(pages) AS p FROM t{n} WHERE {seg} IS NOT NULL GROUP BY ALL),
r{n} AS MATERIALIZED (
  SELECT b.host, b.template, b.s FROM b{n} b
  JOIN (SELECT host, template FROM b{n} GROUP BY ALL HAVING count(*) > {many}) w ON b.host = w.host AND b.template = w.template
  WHERE b.p < {rare}),
t{n + 1} AS MATERIALIZED (
  SELECT t.* EXCLUDE (template, parent),
    CASE WHEN t.{seg} IS NULL THEN t.template ELSE t.template || '/' || CASE WHEN r.s IS NOT NULL THEN '*' ELSE t.{seg} END END AS template,
    CASE WHEN t.{seg} IS NULL THEN t.parent ELSE t.template END AS parent
  FROM t{n} t LEFT JOIN r{n} r ON t.host = r.host AND t.template = r.template AND t.{seg} = r.s)""")
    return ",".join(out)


ORACLES["op4_url_filter"] = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
base AS MATERIALIZED (
  SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                 WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                 WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts),
ruled AS MATERIALIZED (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule FROM base),
paths AS (SELECT host, path, count(*) AS pages, count(*) FILTER (by_rule = 'block') AS bad, count(*) FILTER (by_rule = 'allow') AS good FROM ruled GROUP BY ALL),
typed AS MATERIALIZED (
  SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s:
    CASE WHEN regexp_matches(s, '^[0-9a-f-]{{8,}}$') AND regexp_matches(s, '[0-9]') AND NOT regexp_matches(s, '^[0-9]+$') THEN '{{h}}'
         ELSE regexp_replace(s, '^[0-9]+(\\.[a-z]+)?$', '{{n}}\\1') END) AS segments FROM paths),
{_url_levels()},
placed AS MATERIALIZED (
  SELECT host, path, bad, good, CASE WHEN len(segments) > 6 THEN template ELSE parent END AS parent,
         CASE WHEN len(segments) > 6 THEN template || '/**' ELSE template END AS template FROM t6),
leaves AS MATERIALIZED (SELECT host, parent, template, sum(bad)::DOUBLE AS bad, sum(good)::DOUBLE AS good FROM placed GROUP BY ALL),
pool AS (SELECT host, parent, sum(bad) / sum(bad + good) AS rate FROM leaves WHERE bad + good >= 5 GROUP BY ALL HAVING count(*) > 1),
alike AS (
  SELECT l.host, l.template, l.parent || '/{{~}}' AS branch FROM leaves l JOIN pool p ON l.host = p.host AND l.parent = p.parent
  WHERE bad + good >= 5 AND (bad - (bad + good) * rate) * (bad - (bad + good) * rate) <= 4 * (bad + good) * rate * (1 - rate)),
named AS MATERIALIZED (SELECT l.*, coalesce(a.branch, l.template) AS branch FROM leaves l LEFT JOIN alike a ON l.host = a.host AND l.template = a.template),
branches AS (
  SELECT host, branch, sum(bad + good) >= 5
    AND (sum(bad) + 4.0 * (SELECT coalesce(sum(bad) / nullif(sum(bad + good), 0), 0) FROM leaves)) / (sum(bad + good) + 4.0) >= 0.8 AS rejected
  FROM named GROUP BY ALL)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.by_rule, CASE WHEN b.rejected THEN 'block' ELSE 'allow' END) AS verdict, p.template
FROM ruled r JOIN placed p ON r.host = p.host AND r.path = p.path
JOIN named n ON n.host = p.host AND n.template = p.template JOIN branches b ON b.host = n.host AND b.branch = n.branch
"""

ORACLES["op11_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
sized AS (SELECT *, octet_length(encode(payload)) AS size FROM p),
named AS (SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS original FROM sized)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM named
"""

_TERMS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES["op13_ranked_search"] = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_TERMS.format("text")} AS terms FROM documents WHERE text IS NOT NULL),
sums AS MATERIALIZED (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d),
q AS MATERIALIZED (
  SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
tf AS MATERIALIZED (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, sums GROUP BY term),
impacts AS MATERIALIZED (
  SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms)))) AS impact
  FROM tf JOIN w USING (term), sums),
scored AS (SELECT item_id, row, doc_id, CAST(sum(q * impact) AS BIGINT) AS score FROM q JOIN impacts USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 10
"""
