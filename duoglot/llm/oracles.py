"""SQL for the registered queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1 = f"""WITH w AS (SELECT doc_id, coalesce({WORDS.format('text')}, []) AS ws FROM documents),
spot AS (SELECT doc_id, unnest(range(len(ws) - 49)) AS p, ws FROM w WHERE len(ws) >= 50),
win AS (SELECT doc_id, p, sha256(array_to_string(ws[p + 1:p + 50], ' ')) AS h FROM spot),
earliest AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
hit AS (SELECT doc_id, p FROM win JOIN earliest USING (h) WHERE d < doc_id),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM w),
covered AS (SELECT DISTINCT doc_id, p + k AS p FROM hit CROSS JOIN range(50) r(k)),
marked AS (SELECT word.*, covered.p IS NOT NULL AS gone FROM word LEFT JOIN covered USING (doc_id, p)),
cut AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN cut USING (doc_id)"""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce({WORDS.format(LOWER.format('text'))}, []) AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[p + 1:p + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 3, 1))) AS p FROM w WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y
  WHERE 100 * k >= 80 * (a.n + b.n - k)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION
  SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x),
component AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM component LEFT JOIN size USING (doc_id)"""

# CRC-32 byte by byte with the usual table, once per distinct word.
OP11 = f"""WITH step0 AS (SELECT range AS b, range AS c FROM range(256)),
{''.join(f'''step{k + 1} AS (SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END AS c FROM step{k}),
''' for k in range(8))}crc_table AS (SELECT list(c ORDER BY b) AS t FROM step8),
d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents),
b AS (SELECT regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM b) GROUP BY ALL),
distinct_words AS (SELECT word FROM dw UNION SELECT word FROM bw),
bucket AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, octet_length(encode(word)) + 1), lambda i: CAST('0x' || hex(encode(word))[2 * i - 1:2 * i] AS BIGINT))),
    lambda acc, x: xor(acc // 256, t[1 + xor(acc, x) % 256])), 4294967295) % 10000 AS bucket
  FROM distinct_words, crc_table),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN bucket USING (word) GROUP BY ALL),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN bucket USING (word) GROUP BY ALL),
total AS (SELECT (SELECT coalesce(sum(n), 0) FROM dw) + 10000 AS all_s, (SELECT coalesce(sum(n), 0) FROM bw) + 10000 AS all_t),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * all_s::DOUBLE
    / ((s + 1)::DOUBLE * all_t::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), total),
sums AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
  FROM dw JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY ALL),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE)
    / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN sums USING (doc_id)),
drawn AS (SELECT doc_id, rank FROM (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored
  WHERE n_features >= 20) WHERE rank <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)"""

ORACLES = {"op1_substring_dedup": OP1, "op10_minhash_near_dedup": OP10, "op11_importance_resampling": OP11}
