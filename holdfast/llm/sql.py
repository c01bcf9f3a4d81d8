"""The same results in DuckDB SQL, where SQL can say them."""

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS first_id FROM p),
b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(hex, CAST(5 * i + 1 AS INTEGER), 5))::BIGINT) AS fives FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([15, 10, 5, 0],
           lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((v >> s) & 31) + 1 AS INTEGER), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM b
"""

OP2 = r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
items AS (SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
starts AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM starts),
lens AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM low, lens WHERE len(w) >= n),
hit AS (SELECT r, s, n, item_id FROM (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM grams) JOIN wins USING (n, win)),
words AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS place FROM hit) GROUP BY r),
found AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hit WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""

OP7 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT *, first_value(doc_id) OVER g AS keep_id, first_value(n) OVER g AS keep_n, count(*) OVER (PARTITION BY norm) AS group_size
    FROM t WINDOW g AS (PARTITION BY norm ORDER BY n DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size, n = keep_n AND doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""

OP8 = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT r, unnest(range(0, CAST(length(h) // 2 - 99 AS BIGINT))) AS p, h FROM d WHERE length(h) >= 200),
w AS (SELECT r, p, md5(substr(h, CAST(2 * p + 1 AS INTEGER), 200)) AS m FROM s),
rep AS (SELECT r, p FROM (SELECT r, p, row_number() OVER (PARTITION BY m ORDER BY r, p) AS k FROM w) WHERE k > 1),
cov AS (SELECT DISTINCT r, unnest(range(p, p + 100)) AS b FROM rep),
spans AS (SELECT r, b, b - row_number() OVER (PARTITION BY r ORDER BY b) AS run FROM cov),
n AS (SELECT r, count(*) AS n_removed, count(DISTINCT run) AS n_spans FROM spans GROUP BY r),
bytes AS (SELECT d.r, unnest(range(0, CAST(length(h) // 2 AS BIGINT))) AS b, h FROM d JOIN n USING (r)),
kept AS (SELECT bytes.r, string_agg(substr(h, CAST(2 * b + 1 AS INTEGER), 2), '' ORDER BY b) AS h
    FROM bytes ANTI JOIN cov ON bytes.r = cov.r AND bytes.b = cov.b GROUP BY bytes.r)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n.r IS NULL THEN d.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""

# CRC-32 by its polynomial, a bit at a time; the rest follows the definition, prefix by prefix.
OP13 = """
WITH src AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
orig AS (SELECT conv_id, list({'k': strlen(role) || ':' || role || text, 'n': strlen(text)} ORDER BY turn NULLS FIRST, role, text) AS turns
    FROM src GROUP BY conv_id),
fam AS (SELECT conv_id, turns, conv_id - conv_id % 5 AS head, xor(list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
        lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 9 AS h FROM orig),
built AS (SELECT f.conv_id, list_concat(coalesce(list_slice(o.turns, 1, f.h), []), list_slice(f.turns, f.h + 1, len(f.turns))) AS turns
    FROM fam f LEFT JOIN orig o ON o.conv_id = f.head),
pre AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM built),
nodes AS (SELECT depth, list_slice(turns, 1, depth) AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
        string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(turns) = depth) AS ends, max(len(turns)) = depth AS leaf
    FROM pre GROUP BY 1, 2),
up AS (SELECT n.*, unnest(range(0, depth + 1)) AS d FROM nodes n),
sums AS (SELECT d AS depth, list_slice(p, 1, d) AS p, sum(CAST(leaf AS BIGINT)) AS n_leaves,
        sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * p[depth].n END) AS saved_tokens,
        sum(CASE WHEN depth = d + 1 THEN 1 ELSE 0 END) AS n_children
    FROM up GROUP BY 1, 2)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, CAST(s.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.p = n.p
LEFT JOIN nodes q ON q.depth = n.depth - 1 AND q.p = list_slice(n.p, 1, n.depth - 1)
"""

ORACLES = {"op1_warc_bundles": OP1, "op2_positional_index": OP2, "op7_chunk_recipes": OP7, "op8_suffix_order": OP8,
           "op13_conversation_trie": OP13}
