"""The same results as SQL for a second engine, where SQL can express them."""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 13) AS size, unnest(range(1, greatest(len(w) - 11, 2))) AS p, w FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(w[p:p + size - 1], ' ') AS k FROM bw),
sizes AS (SELECT DISTINCT size FROM windows),
dw AS (SELECT n, size, w, unnest(range(1, len(w) - size + 2)) AS p FROM d JOIN sizes ON len(w) >= size),
found AS (SELECT dw.n, dw.p, dw.size, windows.item FROM dw JOIN windows ON windows.size = dw.size AND windows.k = array_to_string(dw.w[dw.p:dw.p + dw.size - 1], ' ')),
spread AS (SELECT DISTINCT n, unnest(range(p, p + size)) AS word FROM (SELECT DISTINCT n, p, size FROM found)),
hits AS (SELECT n, count(*) AS n_hit FROM spread GROUP BY n),
items AS (SELECT n, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (n) LEFT JOIN items USING (n)
"""

OP6_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn) AS turns FROM t GROUP BY conv_id),
p AS (SELECT conv_id, len(turns) AS size, unnest(range(1, len(turns) + 1)) AS n, turns FROM c),
prefixes AS (SELECT n, CAST(turns[1:n] AS VARCHAR) AS k, max(size) AS longest FROM p GROUP BY ALL),
whole AS (SELECT min(conv_id) AS conv_id, len(turns) AS n, CAST(turns AS VARCHAR) AS k FROM c GROUP BY ALL),
kept AS (SELECT conv_id FROM whole JOIN prefixes USING (n, k) WHERE longest = n),
parts AS (SELECT conv_id, unnest(range(0, (len(turns) + 63) // 64)) AS part, turns FROM c SEMI JOIN kept USING (conv_id)),
cut AS (SELECT conv_id, part, turns[part * 64 + 1:part * 64 + 64] AS own FROM parts)
SELECT conv_id, part, CAST(len(own) AS BIGINT) AS n_turns,
       list_aggregate(list_transform(own, lambda t: '<|im_start|>' || t.r || chr(10) || t.x || '<|im_end|>' || chr(10)), 'string_agg', '') AS text
FROM cut
"""

_TERMS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS no, doc_id, {_TERMS} AS w FROM documents),
stats AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
o AS (SELECT no, unnest(w) AS term FROM d),
tf AS (SELECT no, term, count(*) AS tf FROM o SEMI JOIN q USING (term) GROUP BY no, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, stats GROUP BY term, n_docs),
sizes AS (SELECT no, doc_id, 50 + (50 * len(w) * n_docs) // n_terms AS m FROM d, stats WHERE len(w) > 0),
scores AS (
    SELECT item_id, doc_id, no, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM q JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (no) GROUP BY item_id, doc_id, no
),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d)),
later AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP11_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_FOLD}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
occurrences AS (
    SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' '))) FROM w WHERE len(w) > 1
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) FROM w WHERE len(w) > 2
),
f AS (SELECT lang, size, phrase, count(*) AS n FROM occurrences GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE size > 1),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM c),
sides AS (SELECT c.lang, c.phrase, c.a, c.k, x.n AS l, y.n AS r,
                 CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(x.n AS HUGEINT) * y.n) AS BIGINT) AS score
          FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
                      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
lowest AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE size = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE size = 3) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
