"""DuckDB SQL for the queries that SQL can express."""

#: The part of a url that the contract calls host and path, and its longest fitting rule.
_URLS = r"""
parts AS (
  SELECT page_id, lower(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS low,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
rules(rule, own, prefix, says) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
  ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
strict(term) AS (VALUES {strict}),
soft(term) AS (VALUES {soft})
"""


def url_filter_sql(strict, soft, limit: int) -> str:
    values = lambda terms: ", ".join(f"('{x}')" for x in terms)
    hits = "(SELECT count(*) FROM {0} WHERE regexp_matches(p.low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])'))"
    return f"""
WITH {_URLS.format(strict=values(strict), soft=values(soft))},
ruled AS (
  SELECT p.*, (SELECT max_by(rule, length(rule)) FROM rules WHERE (p.host = own OR ends_with(p.host, '.' || own)) AND starts_with(p.path, prefix)) AS rule,
         {hits.format('strict')} AS n_strict, {hits.format('soft')} AS n_soft
  FROM parts p
)
SELECT page_id, host, path, ruled.rule AS rule,
       coalesce((SELECT says FROM rules r WHERE r.rule = ruled.rule), CASE WHEN n_strict > 0 OR n_soft >= {limit} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""


CONTAMINATION = r"""
WITH words AS (
  SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w, false AS is_item FROM documents
  UNION ALL SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), true FROM benchmark
),
lengths AS (SELECT DISTINCT least(5, len(w)) AS n FROM words WHERE is_item),
shingles AS (
  SELECT DISTINCT id, is_item, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT id, is_item, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM words JOIN lengths ON n BETWEEN 1 AND len(w) AND (NOT is_item OR n = least(5, len(w))))
),
sizes AS (SELECT id AS item_id, count(*) AS n_shingles FROM shingles WHERE is_item GROUP BY 1),
found AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_found
  FROM shingles d JOIN shingles i ON d.s = i.s AND d.n = i.n AND NOT d.is_item AND i.is_item GROUP BY 1, 2
)
SELECT doc_id, item_id, n_shingles, n_found, n_found / CAST(n_shingles AS DOUBLE) AS containment
FROM found JOIN sizes USING (item_id) WHERE n_found >= 0.8 * n_shingles - 1e-9
"""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
),
firsts AS (SELECT k, min(doc_id) AS lo FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT doc_id, pos, line, coalesce(doc_id > lo, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def secret_scan_sql(rules, base: int) -> str:
    """Every rule on every text: starts from the lengths of matches and of the gaps between them."""

    def one(i: int, r) -> str:
        p = r.pattern.replace("'", "''")
        return f"""SELECT doc_id, {i} AS rule, m, x, unnest(range(1, len(m) + 1)) AS k, g FROM (
  SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {r.group}) AS x, regexp_split_to_array(text, '{p}') AS g
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"""

    kinds = ", ".join(f"({i}, '{r.kind}', {r.least})" for i, r in enumerate(rules))
    counts = ", ".join(f"count(*) FILTER (WHERE rule = {i}) AS n_{rules[i].kind}" for i in range(base))
    return f"""
WITH kinds(rule, kind, least) AS (VALUES {kinds}),
matches AS ({" UNION ALL ".join(one(i, r) for i, r in enumerate(rules))}),
placed AS (
  SELECT doc_id, rule, length(m[k]) AS size, length(x[k]) AS own,
         sum(length(g[k])) OVER w + coalesce(sum(length(m[k])) OVER (PARTITION BY doc_id, rule ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM matches WINDOW w AS (PARTITION BY doc_id, rule ORDER BY k)
),
spans AS (
  SELECT doc_id, rule, start, kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span FROM placed JOIN kinds USING (rule) WHERE own >= least
),
summed AS (
  SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY start, rule) FILTER (WHERE rule < {base}) AS base, string_agg(span, ',' ORDER BY start, rule) AS spans
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{rules[i].kind}, 0) AS n_{rules[i].kind}" for i in range(base))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN summed USING (doc_id)
"""


EMBEDDING_DEDUP = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
),
usable AS (
  SELECT * FROM vectors WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
),
reach(a, b) AS (SELECT vec_id, vec_id FROM vectors UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, min(b) AS component_id, vec_id = min(b) AS kept
FROM vectors JOIN reach ON a = vec_id GROUP BY vec_id
"""


FILTER_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
firsts AS (SELECT text, min(doc_id) AS low FROM texts GROUP BY text),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > low THEN 'E' ELSE '' END AS fails
  FROM texts JOIN firsts USING (text) LEFT JOIN known USING (doc_id)
),
letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f
),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, '[' || filter_order[1:step - 1] || '_]' AS before
  FROM orders, range(1, 6) t(step)
),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM masks GROUP BY 1, 2),
judged AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS hit, regexp_matches(fails, before) AS gone FROM cells, steps
),
counted AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (WHERE NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE hit AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = f), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE hit AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain integer k-means on each part, a pair of statements a round."""
    away = "list_sum(list_transform(list_zip(x, c), lambda z: CAST(z[1] - z[2] AS HUGEINT) * (z[1] - z[2])))"

    def assigned(i: int) -> str:
        return f"""near{i} AS MATERIALIZED (
  SELECT vec_id, label, p, x, min({away} * {entries} + e) AS best FROM cut JOIN book{i} USING (p) GROUP BY 1, 2, 3, 4
)"""

    def refined(i: int) -> str:
        return f"""sums{i} AS (
  SELECT p, best % {entries} AS e, j, sum(x[j]) AS s, count(*) AS n FROM near{i}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM cut) + 1)) AS j) GROUP BY 1, 2, 3
),
means{i} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM sums{i} GROUP BY 1, 2),
book{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN means{i} m USING (p, e))"""

    steps = ",\n".join(f"{assigned(i)},\n{refined(i)}" for i in range(rounds))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
cut AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})
),
{steps},
{assigned(rounds)},
coded AS (
  SELECT vec_id, label, string_agg(lpad(to_hex(best % {entries}), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY 1, 2
),
spelled AS (SELECT string_agg(array_to_string(c, ','), ',' ORDER BY p, e) AS books FROM book{rounds})
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha256(books) AS codebooks_sha256 FROM coded, spelled
"""
