"""DuckDB SQL with the rows of those queries of this subpackage that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LOWER_WORDS = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"

#: The CRC-32 of a short ASCII text.
CRC32 = """xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT),
    lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295)"""

OP6 = f"""
WITH RECURSIVE words AS (SELECT doc_id, row_number() OVER () AS r, {LOWER_WORDS} AS ws FROM documents),
sets AS (
    SELECT doc_id, r, list_distinct(CASE
        WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
        WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingles
    FROM words),
tokens AS (SELECT r, len(shingles) AS n, unnest(shingles) AS t FROM sets),
links AS (
    SELECT a.r AS x, b.r AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.r <> b.r AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
    GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT r AS x, r AS y FROM sets UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
firsts AS (SELECT reach.x AS r, min(sets.doc_id) AS component_id FROM reach JOIN sets ON reach.y = sets.r GROUP BY reach.x)
SELECT doc_id, len(shingles) AS n_shingles, component_id FROM sets JOIN firsts USING (r)
"""

OP9 = """
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
digests AS (
    SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS head FROM payloads)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(hex, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
    CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN head = page_id THEN NULL ELSE head END AS refers_to
FROM digests
"""

RULES_BASE = rf"""
WITH words AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS m
    FROM (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM words))),
repeats AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM windows WHERE m > 1) GROUP BY doc_id),
measured AS (
    SELECT words.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
            - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
        coalesce(repeats.n, 0) AS n_repeat_words
    FROM words LEFT JOIN repeats ON words.doc_id = repeats.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured
"""

MEDIA_PAYLOAD = """
WITH sizes AS (
    SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, greatest(1, (strlen(coalesce(text, '')) + 575) // 576) * 576 AS payload_bytes, coalesce(text, '') AS text
    FROM documents)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, payload_bytes::BIGINT AS payload_bytes,
    sha256(encode(text) || from_hex(repeat('ff', (payload_bytes - n_bytes)::INTEGER))) AS payload_sha256
FROM sizes
"""

PII_COUNTS = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS (
    SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email,
        regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
        list_transform(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
        list_transform(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone
    FROM texts)
SELECT doc_id, len(email) AS n_email,
    len(list_filter(ip, lambda x: list_max(list_transform(string_split(x, '.'), lambda p: p::HUGEINT)) <= 255)) AS n_ip,
    len(list_filter(card, lambda x: length(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda k:
        CASE WHEN k % 2 = 1 THEN substr(x, -k, 1)::INTEGER ELSE 2 * substr(x, -k, 1)::INTEGER - 9 * (substr(x, -k, 1)::INTEGER > 4)::INTEGER END)) % 10 = 0)) AS n_card,
    len(list_filter(phone, lambda x: length(x) BETWEEN 9 AND 15)) AS n_phone
FROM found
"""

LM_BASE = f"""
WITH texts AS (SELECT doc_id, {CRC32.format(text="doc_id::VARCHAR")} % 10 = 0 AS held_out, list_append({LOWER_WORDS}, '') AS ws FROM documents),
tokens AS (SELECT doc_id, held_out, unnest(ws) AS w FROM texts),
counts AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w),
sums AS (SELECT sum(c)::BIGINT AS total, count(*) AS kinds FROM counts)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(total) AS train_tokens,
    round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (total + 0.1::DOUBLE * (kinds + 1)))), 2) AS base_score
FROM tokens LEFT JOIN counts ON tokens.w = counts.w CROSS JOIN sums GROUP BY doc_id, held_out
"""

OP11 = f"""
WITH RECURSIVE crcs AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b)) AS crc),
runs AS (
    SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
    WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (
    SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h, crc FROM runs, crcs),
summed AS (
    SELECT run, n, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT),
        lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS c FROM hashed),
spoiled AS (SELECT n, CASE WHEN c % 97 = 0 THEN substr(run, 1, (c % length(run))::INTEGER) || substr(run, (c % length(run))::INTEGER + 2) ELSE run END AS word FROM summed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spoiled WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS i FROM words)),
pairs AS (
    SELECT a.word, a.n, b.word AS other, b.n AS m FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({{'less': -m, 'other': other}}) AS top FROM pairs GROUP BY word),
forms AS (
    SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.less >= 2 * n THEN top.other END AS form, CASE WHEN -top.less >= 2 * n THEN -top.less END AS form_n
    FROM words LEFT JOIN best ON words.word = best.word),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON chain.root = forms.word WHERE form IS NOT NULL),
ends AS (SELECT chain.word, root FROM chain JOIN forms ON chain.root = forms.word WHERE form IS NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN ends ON forms.word = ends.word
"""

OP12 = """
WITH own AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])), lambda a, b: a + b)) AS score
    FROM own q JOIN own c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""

TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, {TERMS} AS ts FROM documents),
sums AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM texts),
postings AS (SELECT r, doc_id, len(ts) AS n, t, count(*) AS tf FROM (SELECT r, doc_id, ts, unnest(ts) AS t FROM texts) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, sums GROUP BY t),
items AS (SELECT DISTINCT item_id, i, unnest(ts) AS t FROM (SELECT item_id, row_number() OVER () AS i, {TERMS} AS ts FROM benchmark)),
scored AS (
    SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM items JOIN postings USING (t) JOIN weights USING (t), sums GROUP BY i, item_id, r, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""

ORACLES = {"op11_spelling": OP11, "op12_vantage": OP12, "op13_lexical": OP13, "op6_jaccard_join": OP6, "op9_warc": OP9, "rules_base": RULES_BASE, "media_payload": MEDIA_PAYLOAD, "pii_counts": PII_COUNTS, "lm_base": LM_BASE}
