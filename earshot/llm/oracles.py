"""SQL for the queries that SQL can express, in DuckDB's dialect."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i+4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT p.a, p.b
  FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
        FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach(doc_id, other) AS (
  SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY 1) r USING (doc_id)
"""

OP5 = """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, i, lines[i:i+2] AS body
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l WHERE len(lines) >= 3)
  WHERE regexp_matches(array_to_string(lines[i:i+2], ''), '[^ \\t\\n\\f\\r\\v]')),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS place FROM later, range(0, 3) t(k)),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM l) x
  ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, d.lang, d.source, d.n_chars,
  coalesce(len(l.lines), 0)::BIGINT AS n_lines, (coalesce(len(l.lines), 0) - coalesce(k.n, 0))::BIGINT AS n_removed
FROM documents d JOIN l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
b AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
items AS (
  SELECT item_id, least(len(words), 13) AS k, words[i:i+12] AS body
  FROM (SELECT item_id, words, unnest(range(1, greatest(2, len(words) - 11))) AS i FROM b WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT k FROM items),
places AS (
  SELECT doc_id, k, i, words[i:i+k-1] AS body
  FROM (SELECT doc_id, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM d, lengths WHERE len(words) >= k)),
found AS (SELECT p.doc_id, p.k, p.i, t.item_id FROM places p JOIN items t ON t.body = p.body AND t.k = p.k),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM found) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY 1)
SELECT d.doc_id, coalesce(len(d.words), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(d.words), 0) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH d AS (
  SELECT row_number() OVER () AS place, doc_id, {_TERMS} AS terms FROM documents),
n AS (SELECT place, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
tf AS (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM d) GROUP BY 1, 2),
asked AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), totals),
m AS (SELECT place, doc_id, 100 - 50 + ((50 * n * docs) // words) AS m FROM n, totals WHERE doc_id IS NOT NULL),
scored AS (
  SELECT item_id, place, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN m USING (place) GROUP BY 1, 2, 3)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank
  FROM scored WHERE score > 0) WHERE rank <= 50
"""
