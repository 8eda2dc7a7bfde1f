"""DuckDB statements of the queries that SQL can express."""

# Equal after deleting white space; the longest original stays, then the smallest id.
OP6 = r"""
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), placed AS (
  SELECT doc_id, body, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size
  FROM rows WINDOW w AS (PARTITION BY body ORDER BY length(t) DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256 FROM placed
"""

# Distinct 3-word shingles, links at Jaccard 0.9, components by reachability.
OP9 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT d.doc_id, count(s.s) AS n FROM documents d LEFT JOIN shingles s ON s.doc_id = d.doc_id GROUP BY d.doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y
)
SELECT s.doc_id, s.n AS n_shingles, min(r.y) AS component_id FROM sizes s JOIN reach r ON r.x = s.doc_id GROUP BY ALL
"""

# Five filters by their conditions on words, characters and earlier equal texts; every order of them, step by step.
OP11 = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d
), f AS (
  SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(first_id < doc_id, false) AS e FROM w
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), x AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
         || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), letters(k) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')), orders AS (
  SELECT p.k || q.k || r.k || s.k || t.k AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE q.k <> p.k AND r.k NOT IN (p.k, q.k) AND s.k NOT IN (p.k, q.k, r.k) AND t.k NOT IN (p.k, q.k, r.k, s.k)
), steps AS (
  SELECT o, s.i AS step, substr(o, s.i, 1) AS k, substr(o, 1, s.i - 1) AS before FROM orders, (VALUES (1), (2), (3), (4), (5)) AS s(i)
), rows AS (
  SELECT x.part, o, step, k, n, good, toxic, contains(fails, k) AS fails_it, fails = k AS only_it,
         (before <> '' AND translate(fails, before, '') <> fails) AS gone
  FROM x, steps
), sums AS (
  SELECT part, o AS filter_order, step::INT AS step, k, sum(CASE WHEN NOT gone AND NOT fails_it THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN NOT gone AND fails_it THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND fails_it THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN only_it THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT gone AND fails_it THEN n * good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN NOT gone AND fails_it THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost FROM rows GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM sums
"""

# Line rules, then the share of words that remains; words inside five-word windows found twice or more.
OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), spots AS (
  SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5
), twice AS (
  SELECT r, unnest(list(i)) AS i FROM spots GROUP BY r, w[i:i + 4] HAVING count(*) > 1
), covered AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r
), l AS (
  SELECT r, line, trim(regexp_replace(lower(line), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS low,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(line, '[|»›•·]')) AS items,
         len(regexp_extract_all(line, '[!?！？#*$%&|<>]')) AS marks
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), good AS (
  SELECT r, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN
    (items >= 2 AND items * 4 >= n) OR low IN ('home', 'menu', 'search', 'login', 'log in', 'sign in', 'sign up', 'register', 'next', 'previous', 'back',
      'back to top', 'share', 'read more', 'more', 'contact', 'contact us', 'about', 'about us', 'sitemap', 'skip to content', 'skip to main content',
      'print', 'reply')
    OR (n <= 40 AND regexp_matches(low, 'lorem ipsum|javascript|cookie policy|uses cookies|use cookies|use of cookies|privacy policy|terms of use|terms of service|terms and conditions|all rights reserved|powered by|click here|subscribe to our newsletter|follow us on'))
    OR NOT regexp_matches(line, '[.!?…。！？؟।]["''“”‘’»」)\]]*[\x20\x09-\x0D]*$') OR (marks >= 3 AND marks * 4 >= n) THEN 0 ELSE n END) AS kept_words
  FROM l GROUP BY r
), base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         coalesce(kept_words, 0) AS kept_words
  FROM d LEFT JOIN covered c USING (r) LEFT JOIN good USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * kept_words >= 50 * n_words AS kept, kept_words::BIGINT AS kept_words FROM base
"""

# Rebuilt conversations, every distinct prefix of them, and sums over the nodes below it (CRC-32 bit by bit).
OP13 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS v FROM t GROUP BY conv_id
), hashed AS (
  SELECT conv_id, v, conv_id - conv_id % 100 AS base, xor(list_reduce(
    list_concat([4294967295], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295) % 6 AS h FROM own
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.v, [])[1:a.h], a.v[a.h + 1:]) AS p FROM hashed a LEFT JOIN own b ON b.conv_id = a.base
), members AS (
  SELECT conv_id, d, p[1:d] AS p, len(p) = d AS ends FROM (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM members GROUP BY p, d
), kids AS (
  SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
), valued AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(n.p[d].t) END AS saved FROM nodes n LEFT JOIN kids k ON k.p = n.p
), sums AS (
  SELECT p[1:e] AS p, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT p, n_children, saved, unnest(range(0, d + 1)) AS e FROM valued) GROUP BY 1
)
SELECT v.conv_id, v.d AS depth, CASE WHEN v.d > 0 THEN up.conv_id END AS parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM valued v JOIN sums s ON s.p = v.p LEFT JOIN nodes up ON up.p = v.p[1:v.d - 1] AND up.d = v.d - 1
"""

ORACLE = {"op6_exact_dedup": OP6, "op9_jaccard": OP9, "op11_filter_audit": OP11, "op12_line_quality": OP12,
          "op13_prefix_trie": OP13}
