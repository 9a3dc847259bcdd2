"""SQL, for DuckDB, with the results of the text queries. Those that SQL cannot state have none."""

OP1 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept, sha256(plain) AS text_sha256
FROM d WINDOW best AS (PARTITION BY plain ORDER BY chars DESC, doc_id)
"""

OP4 = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), md5(coalesce(text, ''))) - 1 AS position
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), said AS (
  SELECT t.conv_id, perspective, position // 64 AS part, position, role = perspective AS own,
         '<|im_start|>' || replace(CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system'
           ELSE 'user name=' || regexp_replace(role, '\s', '_', 'g') END, '<|', '< |') || chr(10) AS head,
         replace(text, '<|', '< |') || '<|im_end|>' || chr(10) AS body
  FROM t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY position) AS stop FROM said
)
SELECT conv_id, perspective, part, count(*) AS n_turns, max(stop)::BIGINT AS n_chars,
       sha256(string_agg(head || body, '' ORDER BY position)) AS text_sha256,
       coalesce(string_agg(CASE WHEN own THEN (stop - length(body))::BIGINT || '-' || stop::BIGINT END, ',' ORDER BY position), '') AS mask
FROM placed GROUP BY conv_id, perspective, part
"""

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w
                      ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM w
), one AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), lead AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN lead USING (doc_id)
"""

OP8 = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), q AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest, max(page_id) OVER (PARTITION BY payload) AS lead FROM p
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> lead THEN lead END AS refers_to
FROM q
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT item_id, least(13, len(w)) AS span,
         unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda s: array_to_string(w[s:s + least(13, len(w)) - 1], ' '))) AS gram
  FROM i WHERE len(w) > 0
), spans AS (
  SELECT DISTINCT span FROM windows
), grams AS (
  SELECT doc_id, span, place, array_to_string(w[place:place + span - 1], ' ') AS gram
  FROM (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS place FROM d JOIN spans ON len(w) >= span)
), hits AS (
  SELECT DISTINCT doc_id, item_id, grams.span, place FROM grams JOIN windows ON grams.gram = windows.gram AND grams.span = windows.span
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + span)) AS p FROM hits) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN names USING (doc_id)
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, place, array_to_string(w[place:place + 12], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS place FROM d WHERE len(w) >= 13)
), least AS (
  SELECT doc_id, place, min(doc_id) OVER (PARTITION BY gram) AS first_id FROM grams
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(place, place + 13)) AS place FROM least WHERE first_id < doc_id
), marks AS (
  SELECT doc_id, count(*) AS n, list(place) AS places FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS words
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d) ANTI JOIN gone USING (doc_id, place)
  GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN marks USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: crc32 of a word: its bytes one after the other, each by eight steps of the polynomial.
OP12 = r"""
WITH RECURSIVE steps AS (
  SELECT i AS byte, i::BIGINT AS c, 0 AS n FROM range(256) t(i)
  UNION ALL
  SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8
), crc AS (
  SELECT list(c ORDER BY byte) AS t FROM steps WHERE n = 8
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), one AS (
  SELECT doc_id, unnest(w) AS word FROM d
), words AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(hex(encode(word))) // 2 + 1),
           lambda k: ('0x' || substr(hex(encode(word)), 2 * k - 1, 2))::BIGINT)),
         lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM one UNION SELECT word FROM i), crc
), source AS (
  SELECT bucket, count(*) AS n FROM one JOIN words USING (word) GROUP BY bucket
), goal AS (
  SELECT bucket, count(*) AS n FROM i JOIN words USING (word) GROUP BY bucket
), gains AS (
  SELECT b.bucket, floor(1000 * ln((coalesce(g.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM one) + 10000)
                         / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM i) + 10000))))::BIGINT AS gain
  FROM range(10000) b(bucket) LEFT JOIN source s USING (bucket) LEFT JOIN goal g USING (bucket)
), weights AS (
  SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM one JOIN words USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scores AS (
  SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)
), ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scores LEFT JOIN ranks USING (doc_id)
"""

ORACLE = {
    "op1_exact_dedup": OP1,
    "op4_perspective_rotation": OP4,
    "op7_minhash_near_dedup": OP7,
    "op8_warc_normaliser": OP8,
    "op10_prefix_decontamination": OP10,
    "op11_recompression": OP11,
    "op12_importance_resampling": OP12,
}
