"""SQL for the rows of those queries that SQL can express, over whole tables."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
h AS (SELECT *, list_transform(ls, lambda x: md5(x)) AS hs FROM l),
r AS (SELECT *, list_transform(range(1, len(hs) + 1), lambda i: md5(CASE WHEN i > 1 THEN hs[i - 1] ELSE '' END || hs[i])) AS rs FROM h),
b AS (SELECT doc_id, ls, list_concat([0], list_filter(range(2, len(rs) - 1), lambda i: rs[i] < rs[i - 1] AND rs[i] <= rs[i + 1]), [len(ls)]) AS cuts
      FROM r WHERE text IS NOT NULL),
j AS (SELECT *, unnest(range(1, len(cuts))) AS j FROM b),
c AS (SELECT doc_id, cuts[j] AS start, cuts[j + 1] - cuts[j] AS n, len(ls) AS n_lines, array_to_string(ls[cuts[j] + 1 : cuts[j + 1]], chr(10)) AS chunk FROM j),
o AS (SELECT *, n_lines >= 2 AND regexp_matches(chunk, '\\S') AND row_number() OVER (PARTITION BY chunk, n_lines >= 2 ORDER BY doc_id, start) > 1 AS gone FROM c),
t AS (SELECT doc_id, coalesce(string_agg(chunk, chr(10) ORDER BY start) FILTER (WHERE NOT gone), '') AS text, min(n_lines) AS n_lines,
      coalesce(sum(n) FILTER (WHERE gone), 0) AS n_removed FROM o GROUP BY doc_id)
SELECT doc_id, t.text, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed FROM documents LEFT JOIN t USING (doc_id)
"""

_WORDS = f"list_filter(regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT item, least(10, len(ws)) AS k, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS j FROM i WHERE len(ws) > 0),
w AS (SELECT DISTINCT item, k, array_to_string(ws[j : j + k - 1], ' ') AS phrase FROM iw),
k AS (SELECT DISTINCT k FROM w),
p AS (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS j FROM d, k WHERE len(ws) >= k),
g AS (SELECT doc_id, k, j, array_to_string(ws[j : j + k - 1], ' ') AS phrase FROM p),
m AS (SELECT doc_id, k, j, item FROM g JOIN w USING (k, phrase)),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS pos FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')))
                                 WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, root AS component_id
FROM (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""

LM_SCORING = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
c1 AS (SELECT w, count(*) AS c FROM p GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= 2),
c3 AS (SELECT u, v, w, count(*) AS c FROM p WHERE u IS NOT NULL GROUP BY u, v, w HAVING count(*) >= 2),
n AS (SELECT count(*) AS total FROM p),
s AS (SELECT doc_id, CASE WHEN c3.c IS NOT NULL THEN 3 WHEN c2.c IS NOT NULL THEN 2 ELSE 1 END AS k,
             CASE WHEN c3.c IS NOT NULL THEN ln(c3.c / h2.c)
                  WHEN c2.c IS NOT NULL THEN ln(c2.c / h1.c) + CASE WHEN i > 2 THEN ln(0.4) ELSE 0 END
                  ELSE ln(c1.c / total) + least(i - 1, 2) * ln(0.4) END AS score
      FROM p CROSS JOIN n JOIN c1 ON c1.w = p.w LEFT JOIN c1 h1 ON h1.w = p.v LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w
      LEFT JOIN c2 h2 ON h2.v = p.u AND h2.w = p.v LEFT JOIN c3 ON c3.u = p.u AND c3.v = p.v AND c3.w = p.w),
t AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE k = 1) AS n_order1, count(*) FILTER (WHERE k = 2) AS n_order2,
             count(*) FILTER (WHERE k = 3) AS n_order3, round(sum(score) / count(*), 6) AS score FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_order1, 0) AS n_order1, coalesce(n_order2, 0) AS n_order2,
       coalesce(n_order3, 0) AS n_order3, score FROM documents LEFT JOIN t USING (doc_id)
"""

_TERMS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

RANKED_SEARCH = f"""
WITH d AS (SELECT doc_id, list_filter({_TERMS}, lambda x: x <> '') AS ts FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, unnest(ts) AS term FROM d),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
s AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
m AS (SELECT doc_id, 100 - 75 + ((75 * len(ts) * n) // l) AS m FROM d, s WHERE len(ts) > 0),
q AS (SELECT row_number() OVER () AS item, item_id, list_filter({_TERMS}, lambda x: x <> '') AS ts FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(ts) AS term FROM q) GROUP BY 1, 2, 3),
c AS (SELECT item, item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
      FROM p JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2, 3),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
