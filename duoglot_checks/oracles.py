"""The same results as one SQL statement each, over the same tables."""

from __future__ import annotations

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
BREAK = r"[^\p{L}\p{N}\p{M}]+"
SEP = "' ' || chr(10) || ' '"
NL = "chr(10)"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}', ''), '{WS}$', '')"


def nfc(x: str) -> str:
    return strip(f"nfc_normalize({x})")


def words(x: str) -> str:
    return f"unnest(string_split_regex(lower({x}), '{BREAK}'))"


def lang(x: str) -> str:
    return (f"CASE WHEN regexp_matches({x}, '[一-鿿]') THEN 'zh' "
            f"WHEN regexp_matches({x}, '[Ѐ-ӿ]') THEN 'ru' "
            f"WHEN regexp_matches({x}, '[āīūḍḷṇṭñĀĪŪḌḶṆṬÑ]') THEN 'pali' ELSE 'en' END")


def uuid5(x: str) -> str:
    h = f"sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode({x}))"
    return (f"substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'"
            f"||translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab')"
            f"||substr({h},18,3)||'-'||substr({h},21,12)")


RAW = {
    "documents": """raw AS (SELECT source AS book_id, CAST(doc_id AS VARCHAR) AS para_id,
  CASE WHEN lang IS DISTINCT FROM 'en' THEN text END AS pali, CASE WHEN lang = 'en' THEN text END AS tr
  FROM documents)""",
    "conversations": """raw AS (SELECT 'conv' || conv_id AS book_id, CAST(turn AS VARCHAR) AS para_id, pali, tr,
  NULL::VARCHAR AS zh, NULL::VARCHAR AS ru
  FROM (SELECT conv_id, turn, text AS pali FROM conversations WHERE role = 'user')
  FULL JOIN (SELECT conv_id, turn - 1 AS turn, text AS tr FROM conversations WHERE role = 'assistant')
  USING (conv_id, turn) UNION ALL
  SELECT 'conv' || conv_id, 'other' || turn, NULL, NULL, CASE WHEN conv_id % 2 = 0 THEN text END,
  CASE WHEN conv_id % 2 <> 0 THEN text END FROM conversations
  WHERE role IS NULL OR role NOT IN ('user', 'assistant'))""",
}


def corpus(kind: str = "documents") -> str:
    if kind == "conversations":
        return f"""{RAW[kind]},
corpus AS (SELECT book_id, para_id, book_id || ':' || para_id AS doc_id, p AS pali_paragraph,
  t AS translation_paragraph, z AS chinese_paragraph, r AS russian_paragraph,
  coalesce(p, '') || {SEP} || coalesce(t, '') || {SEP} || coalesce(z, '') || {SEP} || coalesce(r, '')
    AS multilingual_concat FROM (SELECT book_id, para_id, {nfc('pali')} AS p, {nfc('tr')} AS t,
  {nfc('zh')} AS z, {nfc('ru')} AS r FROM raw))"""
    return f"""{RAW[kind]},
corpus AS (SELECT book_id, para_id, book_id || ':' || para_id AS doc_id,
  p AS pali_paragraph, t AS translation_paragraph,
  coalesce(p, '') || {SEP} || coalesce(t, '') AS multilingual_concat
  FROM (SELECT book_id, para_id, {nfc('pali')} AS p, {nfc('tr')} AS t FROM raw))"""


QUERIES = f"""q0 AS (SELECT item_id AS query_id, text AS query, {lang('text')} AS query_lang,
  0.5::DOUBLE AS alpha, 10 AS top_k, 0.5::DOUBLE AS alpha_used FROM benchmark)"""
ANALYSED = """q AS (SELECT *, CASE WHEN query_lang = 'pali' THEN strip_accents(query)
  ELSE query END AS keyword_query FROM q0)"""


def postings(source: str = "corpus", fields: dict[str, str] | None = None) -> str:
    fields = fields or {"multilingual_concat": "multilingual_concat"}
    parts = " UNION ALL ".join(
        f"SELECT doc_id, '{f}' AS field, {words(x)} AS term FROM {source}"
        for f, x in fields.items())
    return f"""tf AS (SELECT doc_id, field, term, count(*) AS tf FROM ({parts}) WHERE term <> ''
  GROUP BY ALL),
dl AS (SELECT doc_id, field, sum(tf) AS dl FROM tf GROUP BY ALL),
fs AS (SELECT field, count(*) AS n, sum(dl) / count(*) AS avgdl FROM dl GROUP BY ALL),
df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL)"""


def keyword_leg(weights: dict[str, float] | None = None, allowed: str = "true") -> str:
    weights = weights or {"multilingual_concat": 1.0}
    w = " ".join(f"WHEN field = '{f}' THEN {v}" for f, v in weights.items())
    return f"""qt AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, {words('keyword_query')} AS term
  FROM q WHERE alpha_used < 1) WHERE term <> ''),
bm AS (SELECT query_id, doc_id, round(sum((CASE {w} END) * ln(1 + (n - df + 0.5) / (df + 0.5))
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25_score
  FROM qt JOIN tf USING (term) JOIN df USING (field, term) JOIN dl USING (doc_id, field)
  JOIN fs USING (field)
  WHERE field IN ({', '.join(repr(f) for f in weights)})
    AND doc_id IN (SELECT doc_id FROM corpus WHERE {allowed}) GROUP BY ALL),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY bm25_score DESC, doc_id) AS bm25_rank FROM bm) JOIN (SELECT query_id, top_k FROM q)
  USING (query_id) WHERE bm25_rank <= greatest(100, top_k))"""


def hashed(name: str, source: str, key: str, text: str) -> str:
    """Unit vectors of a table of texts in long form: (key, dim, x)."""
    return f"""{name}_w AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, {words(text)} AS term
  FROM {source}) WHERE term <> '' GROUP BY ALL),
{name}_e AS (SELECT * FROM {name}_w UNION ALL
  SELECT {key}, '' AS term, 1 AS tf FROM {source} WHERE ({key}) NOT IN (SELECT ({key}) FROM {name}_w)),
{name}_d AS (SELECT {key}, CAST('0x' || substr(md5(term), 1, 7) AS BIGINT) % 768 AS dim,
  sum(CASE WHEN substr(md5(term), 8, 1) < '8' THEN tf ELSE -tf END)::DOUBLE AS w
  FROM {name}_e GROUP BY ALL),
{name} AS (SELECT {key}, dim, (w / l)::FLOAT::DOUBLE AS x FROM {name}_d
  JOIN (SELECT {key}, sqrt(sum(w * w)) AS l FROM {name}_d GROUP BY ALL) USING ({key})
  WHERE w <> 0)"""


def vector_leg(allowed: str = "true") -> str:
    """Needs qv (query_id, dim, x) and dv (doc_id, dim, x)."""
    return f"""asked_vec AS (SELECT DISTINCT query_id FROM qv JOIN q USING (query_id) WHERE alpha_used > 0
  OR query_id NOT IN (SELECT query_id FROM kw)),
grid AS (SELECT query_id, doc_id FROM asked_vec CROSS JOIN (SELECT doc_id FROM corpus WHERE {allowed})),
dots AS (SELECT query_id, doc_id, sum(qv.x * dv.x) AS s FROM qv JOIN dv USING (dim) GROUP BY ALL),
sims AS (SELECT query_id, doc_id, round(coalesce(s, 0), 6) AS vector_score
  FROM grid LEFT JOIN dots USING (query_id, doc_id)),
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY vector_score DESC, doc_id) AS vector_rank FROM sims)
  JOIN (SELECT query_id, top_k FROM q) USING (query_id) WHERE vector_rank <= greatest(100, top_k))"""


def code_leg(tables: int = 32, bits: int = 8, probes: int = 8, shared: int = 2) -> str:
    """``vector_leg`` among the documents met in the nearest buckets; also ``exact``, the leg without them."""
    def margins(name: str, key: str) -> str:
        return f"""{name}m AS (SELECT {key}, p // {bits} AS tab, {bits - 1} - p % {bits} AS bit,
  CAST(floor(sum(x * s) * 10000 + 0.5) AS BIGINT) AS m FROM {name} JOIN planes ON i = dim GROUP BY {key}, p),
{name}c AS (SELECT {key}, tab, sum(CASE WHEN m >= 0 THEN 1 << bit ELSE 0 END)::BIGINT AS code
  FROM {name}m GROUP BY ALL)"""
    return f"""planes AS MATERIALIZED (SELECT p, i, CASE WHEN substr(md5(p || ':' || i), 1, 1) < '8'
  THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM range({tables * bits}) a(p), range(768) b(i)),
{margins('qv', 'query_id')},
{margins('dv', 'doc_id')},
ways AS (SELECT query_id, tab, mask, sum(CASE WHEN (mask >> bit) & 1 = 1 THEN m * m ELSE 0 END) AS cost
  FROM qvm CROSS JOIN (SELECT range AS mask FROM range({1 << bits})) GROUP BY ALL),
probed AS (SELECT query_id, tab, code FROM (SELECT query_id, tab, xor(code, mask) AS code,
  row_number() OVER (PARTITION BY query_id, tab ORDER BY cost, xor(code, mask)) AS n
  FROM ways JOIN qvc USING (query_id, tab)) WHERE n <= {probes}),
met AS (SELECT query_id, doc_id FROM probed JOIN dvc USING (tab, code) GROUP BY ALL HAVING count(*) >= {shared}),
""" + vector_leg().replace("asked_vec AS", "asked_vec AS MATERIALIZED").replace(
        "vec AS (SELECT * FROM (SELECT *, row", "exact AS (SELECT * FROM (SELECT *, row") + """,
vec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY vector_score DESC, doc_id) AS vector_rank FROM sims JOIN met USING (query_id, doc_id))
  JOIN (SELECT query_id, top_k FROM q) USING (query_id) WHERE vector_rank <= greatest(100, top_k))"""


NO_VECTORS = """vec AS (SELECT query_id, '' AS doc_id, 0.0::DOUBLE AS vector_score,
  0 AS vector_rank FROM q WHERE false)"""


def blend(fusion: str = "relative") -> str:
    if fusion == "rrf":
        score = ("alpha_used * coalesce(1.0 / (60 + vector_rank), 0)"
                 " + (1 - alpha_used) * coalesce(1.0 / (60 + bm25_rank), 0)")
    else:
        score = "alpha_used * v + (1 - alpha_used) * b"
    return f"""cand AS (SELECT * FROM (SELECT query_id, doc_id, bm25_score, bm25_rank, vector_score, vector_rank
  FROM kw FULL JOIN vec USING (query_id, doc_id)) JOIN q USING (query_id)),
span AS (SELECT query_id, min(bm25_score) AS bl, max(bm25_score) AS bh, min(vector_score) AS vl,
  max(vector_score) AS vh, count(bm25_score) AS nb FROM cand GROUP BY ALL),
scaled AS (SELECT *, alpha_used = 0 AND nb = 0 AS fallback,
  CASE WHEN bm25_score IS NULL THEN 0 WHEN bh = bl THEN 1 ELSE (bm25_score - bl) / (bh - bl) END AS b,
  CASE WHEN vector_score IS NULL THEN 0 WHEN vh = vl THEN 1 ELSE (vector_score - vl) / (vh - vl) END AS v
  FROM cand JOIN span USING (query_id)),
mixed AS (SELECT *, CASE WHEN fallback THEN vector_score ELSE round({score}, 6) END AS hybrid_score
  FROM scaled WHERE (bm25_score IS NOT NULL AND alpha_used < 1)
    OR (vector_score IS NOT NULL AND (alpha_used > 0 OR fallback))),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
    ORDER BY hybrid_score DESC, doc_id) AS hybrid_rank FROM mixed)
  WHERE hybrid_rank <= greatest(100, top_k)),
texts AS (SELECT *, concat_ws({SEP}, nullif(pali_paragraph, ''), nullif(translation_paragraph, '')) AS snippet
  FROM corpus)"""


PLAIN_HITS = """hits AS (SELECT query_id, query, query_lang, alpha, alpha_used, hybrid_rank AS rank, doc_id,
  book_id, para_id, pali_paragraph, translation_paragraph, snippet, bm25_score, vector_score,
  hybrid_score AS score, 'hybrid' AS score_type
  FROM ranked JOIN texts USING (doc_id) WHERE hybrid_rank <= top_k)"""
RERANKED_HITS = f"""offered AS (SELECT * FROM ranked JOIN texts USING (doc_id)),
wanted AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, {words('query')} AS term FROM q) WHERE term <> ''),
shown AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, {words('snippet')} AS term
  FROM texts) WHERE term <> ''),
overlap AS (SELECT query_id, doc_id, count(*) AS n FROM offered JOIN wanted USING (query_id)
  JOIN shown USING (doc_id, term) GROUP BY ALL),
sizes AS (SELECT query_id, count(*) AS m FROM wanted GROUP BY ALL),
scored AS (SELECT *, round(coalesce(n, 0)::DOUBLE / m, 6) AS rerank_score FROM offered
  JOIN sizes USING (query_id) LEFT JOIN overlap USING (query_id, doc_id)),
hits AS (SELECT *, rerank_score AS score, 'reranked' AS score_type FROM (SELECT *,
  row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, hybrid_rank) AS rank
  FROM scored) WHERE rank <= top_k)"""

SELECT_HITS = """SELECT query_id, query_lang, alpha::DOUBLE AS alpha, alpha_used::DOUBLE AS alpha_used,
  CAST(rank AS BIGINT) AS rank, doc_id, book_id, para_id, bm25_score::DOUBLE AS bm25_score,
  vector_score::DOUBLE AS vector_score, score::DOUBLE AS score, score_type,
  md5(snippet) AS snippet_md5 FROM hits"""


def search(final: str = SELECT_HITS, kind: str = "documents", queries: str = QUERIES,
           vectors: str | None = "default", fields: dict[str, str] | None = None,
           weights: dict[str, float] | None = None, allowed: str = "true",
           fusion: str = "relative", hits: str = PLAIN_HITS, doc_text: str = "multilingual_concat",
           more: str = "", leg: str | None = None) -> str:
    parts = [corpus(kind), queries]
    if vectors is None:
        parts += ["q1 AS (SELECT * REPLACE (0.0::DOUBLE AS alpha_used) FROM q0)",
                  ANALYSED.replace("FROM q0", "FROM q1")]
    else:
        parts.append(ANALYSED)
    parts += [postings(fields=fields), keyword_leg(weights, allowed)]
    if vectors is None:
        parts.append(NO_VECTORS)
    else:
        if vectors == "default":
            parts.append(hashed("qv", "q", "query_id", "query"))
        else:
            parts.append(vectors)
        parts += [hashed("dv", "corpus", "doc_id", doc_text), leg or vector_leg(allowed)]
    parts += [blend(fusion), hits]
    if more:
        parts.append(more)
    return "WITH " + ",\n".join(parts) + "\n" + final


TAG = "'[' || coalesce(book_id, '?') || ':' || coalesce(para_id, '?') || ']'"
ANSWER_PARTS = f"""ctx AS (SELECT *, {TAG} AS tag,
  {strip("coalesce(nullif(translation_paragraph, ''), pali_paragraph, '')")} AS prim,
  {strip("coalesce(pali_paragraph, '')")} AS p, {strip("coalesce(translation_paragraph, '')")} AS t
  FROM hits),
run AS (SELECT *, coalesce(sum(length(prim)) OVER (PARTITION BY query_id ORDER BY rank
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ctx),
summary AS (SELECT query_id, string_agg(prim, ' ' ORDER BY rank) AS s FROM run
  WHERE rank <= 6 AND before < 600 AND prim <> '' GROUP BY ALL),
blocks AS (SELECT query_id, string_agg(tag || {NL} || (CASE WHEN query_lang = 'pali' THEN p ELSE t END)
    || {NL} || (CASE WHEN query_lang = 'pali' THEN t ELSE p END) || {NL}, {NL} ORDER BY rank) AS c
  FROM run WHERE rank <= 6 AND (p <> '' OR t <> '') GROUP BY ALL),
context AS (SELECT query_id, string_agg(tag || ' ' || concat_ws(' / ', nullif(pali_paragraph, ''),
  nullif(translation_paragraph, '')), {NL} || {NL} ORDER BY rank) AS x FROM run GROUP BY ALL),
found AS (SELECT DISTINCT query_id FROM hits),
answers AS (SELECT q.query_id, q.query_lang AS lang,
  CASE WHEN f.query_id IS NULL THEN 'No matching passages found for: ' || q.query ELSE
    'Extractive bilingual answer (context-stitched)' || {NL} || {NL} || 'Summary:' || {NL}
    || CASE WHEN length(coalesce(s, '')) > 600
         THEN regexp_replace(substr(s, 1, 600), ' [^ ]*$', '') || '…' ELSE coalesce(s, '') END
    || {NL} || {NL} || 'Citations:' || {NL} || coalesce(c, '') END AS answer,
  'Answer in ' || q.query_lang || '. Use only the context and cite [book_id:para_id].' || {NL} || {NL}
    || 'Question: ' || q.query || {NL} || {NL} || 'Context:' || {NL} || coalesce(x, '') || {NL} AS prompt,
  least(10, (SELECT count(*) FROM hits h WHERE h.query_id = q.query_id)) AS n_citations
  FROM q LEFT JOIN found f USING (query_id) LEFT JOIN summary USING (query_id)
  LEFT JOIN blocks USING (query_id) LEFT JOIN context USING (query_id))"""
ANSWERS = "SELECT query_id, lang, answer FROM answers"


def simple(*parts: str, final: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + final


REVISED = f"""before AS (SELECT * FROM corpus),
now_raw AS (SELECT book_id, para_id, 'Revised: ' || pali AS pali, tr FROM raw WHERE pali IS NOT NULL
  UNION ALL SELECT 'bench', CAST(item_id AS VARCHAR), NULL, text FROM benchmark),
after AS (SELECT book_id, para_id, book_id || ':' || para_id AS doc_id,
  coalesce({nfc('pali')}, '') || {SEP} || coalesce({nfc('tr')}, '') AS multilingual_concat FROM now_raw),
final AS (SELECT book_id, para_id, doc_id, multilingual_concat FROM after UNION ALL
  SELECT book_id, para_id, doc_id, multilingual_concat FROM before
  WHERE doc_id NOT IN (SELECT doc_id FROM after))"""

PAIRS = """pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id,
  round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a CROSS JOIN embeddings b)"""
KNN = simple(PAIRS, final="""SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM pairs)
  WHERE rank <= 10""")
LSH = """WITH planes AS (SELECT p, i, CASE WHEN substr(md5(p || ':' || i), 1, 1) < '8' THEN 1.0::DOUBLE
  ELSE -1.0::DOUBLE END AS s FROM range(48) a(p), range(64) b(i)),
comp AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i
  FROM embeddings),
sides AS (SELECT vec_id, p, sum(x * s) >= 0 AS side FROM comp JOIN planes USING (i) GROUP BY ALL),
codes AS (SELECT vec_id, p // 6 AS tab, sum(CASE WHEN side THEN power(2, 5 - p % 6) ELSE 0 END) AS code
  FROM sides GROUP BY ALL),
near AS (SELECT DISTINCT a.vec_id AS query_id, b.vec_id AS doc_id FROM codes a
  JOIN codes b USING (tab, code)),
scored AS (SELECT query_id, doc_id,
  round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM near JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = doc_id)
SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
WHERE rank <= 10"""

AUDIT_COLUMNS = """count(*) AS n_vectors, CAST(min(d) AS INT) AS min_dim, CAST(max(d) AS INT) AS max_dim,
  count(*) FILTER (l = 0) AS n_zero, count(*) FILTER (abs(l - 1) > 1e-5) AS n_not_unit,
  round(min(l), 4) AS min_norm, round(max(l), 4) AS max_norm"""

PASSAGES = """judged AS (SELECT query_id, doc_id FROM q JOIN corpus ON contains(multilingual_concat, query)),
quality AS (SELECT query_id, count(*) AS n_relevant, count(rank) AS n_found, count(rank) > 0 AS hit,
  round(count(rank)::DOUBLE / count(*), 6) AS recall,
  round(coalesce(1.0 / min(rank), 0), 6)::DOUBLE AS reciprocal_rank
  FROM judged LEFT JOIN hits USING (query_id, doc_id) GROUP BY ALL)"""

VARIED = QUERIES.replace("0.5::DOUBLE AS alpha, 10 AS top_k, 0.5::DOUBLE AS alpha_used",
                         "(item_id % 5) / 4.0::DOUBLE AS alpha, 5 + item_id % 10 AS top_k, "
                         "(item_id % 5) / 4.0::DOUBLE AS alpha_used")
ONE_LARGE = QUERIES.replace("10 AS top_k", "CASE WHEN item_id = 0 THEN 1500 ELSE 10 END AS top_k")
FALLBACK = f"""q0 AS (SELECT item_id * 2 AS query_id, md5(text) AS query, 'en' AS query_lang,
  0.0::DOUBLE AS alpha, 10 AS top_k, 0.0::DOUBLE AS alpha_used, text AS vector_text FROM benchmark
  UNION ALL SELECT item_id * 2 + 1, text, {lang('text')}, 0.5, 10, 0.0, NULL FROM benchmark)"""
NOTHING = f"""q0 AS (SELECT query_id, query, {lang('query')} AS query_lang, 0.5::DOUBLE AS alpha, 10 AS top_k,
  0.0::DOUBLE AS alpha_used FROM (SELECT item_id AS query_id,
  CASE WHEN item_id % 2 = 0 THEN md5(text) ELSE text END AS query FROM benchmark))"""

SHORT = f"""q0 AS (SELECT query_id, query, {lang('query')} AS query_lang, 0.5::DOUBLE AS alpha, 10 AS top_k,
  0.5::DOUBLE AS alpha_used FROM (SELECT item_id AS query_id, regexp_extract(text,
  CASE WHEN item_id % 2 = 0 THEN '^[^ ]+ [^ ]+' ELSE '^[^ ]+' END) AS query FROM benchmark))"""

NAMED = f"""named AS (SELECT doc_id, 'pali' AS vector_name, coalesce(pali_paragraph, '') AS txt FROM corpus
  UNION ALL SELECT doc_id, 'en', coalesce(translation_paragraph, '') FROM corpus
  UNION ALL SELECT doc_id, 'zh', coalesce(chinese_paragraph, '') FROM corpus
  UNION ALL SELECT doc_id, 'ru', coalesce(russian_paragraph, '') FROM corpus
  UNION ALL SELECT doc_id, 'multilingual', concat_ws({SEP}, nullif(pali_paragraph, ''),
    nullif(translation_paragraph, ''), nullif(chinese_paragraph, ''), nullif(russian_paragraph, '')) FROM corpus)"""

FOLDED = {"pali_paragraph_ascii": "strip_accents(pali_paragraph)",
          "translation_paragraph_ascii": "strip_accents(translation_paragraph)"}
ALL_FIELDS = {"multilingual_concat": "multilingual_concat", **FOLDED}

ORACLES = {
    "corpus_ingest": simple(corpus(), final="""SELECT doc_id, book_id, para_id, pali_paragraph,
  translation_paragraph, multilingual_concat FROM corpus"""),
    "corpus_dedup": f"""SELECT doc_id, pali_paragraph, line FROM (SELECT source || ':' || lang AS doc_id,
  {nfc('text')} AS pali_paragraph, doc_id AS line, row_number() OVER (
  PARTITION BY source, lang, {nfc('text')} ORDER BY documents.doc_id) AS rn FROM documents)
  WHERE rn = 1""",
    "corpus_fallback_concat": f"""SELECT source || ':' || doc_id AS doc_id, text AS body, lang AS note,
  text || {SEP} || lang || {SEP} || source || ':' || doc_id AS multilingual_concat,
  6::BIGINT AS n_columns FROM documents""",
    "multi_file_union": f"""WITH c AS (SELECT source || ':' || doc_id AS doc_id,
  {nfc("CASE WHEN lang = 'en' THEN text END")} AS english_paragraph,
  {nfc("CASE WHEN lang IS DISTINCT FROM 'en' THEN text END")} AS pali_text FROM documents)
SELECT *, pali_text AS pali_paragraph, english_paragraph AS translation_paragraph,
  coalesce(pali_text, '') || {SEP} || coalesce(english_paragraph, '') AS multilingual_concat FROM c""",
    "csv_ingest": simple(corpus(), final="""SELECT doc_id, book_id, para_id, pali_paragraph,
  translation_paragraph, multilingual_concat FROM corpus"""),
    "na_values": """SELECT doc_id, CASE WHEN lang <> 'de' THEN lang END AS lang,
  CASE WHEN source <> 'src1' THEN source END AS source FROM documents""",
    "run_summary": """SELECT 'ingest' AS run, count(*) AS rows,
  'book_id,para_id / pali_paragraph,translation_paragraph' AS detail FROM documents
UNION ALL SELECT 'index', count(*), 'multilingual' FROM documents""",
    "fold_text": "SELECT doc_id, strip_accents(text) AS text_ascii FROM documents",
    "query_analysis": f"""SELECT query_id, query_lang, CASE WHEN query_lang = 'pali'
  THEN strip_accents(query) ELSE query END AS keyword_query, 10::BIGINT AS top_k, 0.5::DOUBLE AS alpha
FROM (SELECT *, {lang('query')} AS query_lang FROM (SELECT 'q' || item_id AS query_id, text AS query
  FROM benchmark UNION ALL SELECT 'd' || doc_id, text FROM documents))""",
    "doc_uuid5": f"""SELECT doc_id, {uuid5('doc_id')} AS uuid
  FROM (SELECT source || ':' || doc_id AS doc_id FROM documents)""",
    "nonempty_concat": f"""SELECT conv_id, turn, concat_ws({SEP}, nullif(u, ''), nullif(a, '')) AS nonempty,
  coalesce(u, '') || {SEP} || coalesce(a, '') || {SEP} AS every FROM (SELECT conv_id, turn,
  CASE WHEN role = 'user' THEN text END AS u, CASE WHEN role = 'assistant' THEN text END AS a
  FROM conversations)""",
    "snippet": f"""WITH {RAW['conversations'].replace('raw AS', 'c AS')}, {RAW['documents']},
r AS (SELECT book_id, para_id, pali, tr FROM c UNION ALL SELECT * FROM raw)
SELECT book_id, para_id, {TAG} AS tag,
  concat_ws({SEP}, nullif(pali, ''), nullif(tr, '')) AS snippet FROM r""",
    "index_upsert": simple(corpus(), REVISED, final=f"""SELECT {uuid5('doc_id')} AS uuid, doc_id, book_id,
  para_id, md5(multilingual_concat) AS text_md5 FROM final"""),
    "upsert_term_stats": simple(corpus(), REVISED, postings("final"),
                                final="SELECT term, df FROM df"),
    "streaming_upsert": simple(corpus(), final=f"""SELECT {uuid5('doc_id')} AS uuid, doc_id,
  md5(multilingual_concat) AS text_md5 FROM corpus"""),
    "postings": simple(corpus(), postings(), final="""SELECT doc_id, term, tf, CAST(dl AS BIGINT) AS dl
  FROM tf JOIN dl USING (doc_id, field)"""),
    "term_stats": simple(corpus(), postings(fields=ALL_FIELDS),
                         final="SELECT field, term, df FROM df"),
    "hash_encode": simple(hashed("v", "documents", "doc_id", "text"),
                          final="SELECT doc_id, dim, round(x, 6) AS weight FROM v"),
    "named_vectors": simple(corpus("conversations"), NAMED,
                            hashed("v", "named", "doc_id, vector_name", "txt"),
                            final="SELECT doc_id, vector_name, dim, round(x, 6) AS weight FROM v"),
    "l2_normalize": """WITH e AS (SELECT vec_id, unnest(embedding) * (vec_id + 2)::FLOAT AS y,
  generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
f AS (SELECT vec_id, dim, y::FLOAT::DOUBLE AS y FROM e),
l AS (SELECT vec_id, sqrt(sum(y * y)) AS l FROM f GROUP BY ALL)
SELECT vec_id, CAST(dim AS BIGINT) AS dim, round((y / l)::FLOAT::DOUBLE, 5) AS x FROM f JOIN l USING (vec_id)""",
    "knn_cosine": KNN, "knn_tiled": KNN, "knn_lsh": LSH,
    "bm25_topk": search(vectors=None), "bm25_pruned": search(vectors=None),
    "bm25_impact_ranges": search(vectors=None),
    "bm25_fields": search(vectors=None, fields=FOLDED, weights={
        "pali_paragraph_ascii": 2.0, "translation_paragraph_ascii": 1.0}),
    "bm25_salted": simple(corpus(), QUERIES, ANALYSED, postings(), keyword_leg(),
                          final="""SELECT query_id, doc_id, bm25_score AS score,
  CAST(bm25_rank AS BIGINT) AS rank FROM kw WHERE bm25_rank <= 10"""),
    "bm25_impact_batches": simple(corpus(), QUERIES, ANALYSED, postings(), keyword_leg(),
                                  final="""SELECT query_id, doc_id, bm25_score AS score,
  CAST(bm25_rank AS BIGINT) AS rank FROM kw WHERE bm25_rank <= 10"""),
    "search_lsh": search(queries=QUERIES.replace("0.5::DOUBLE", "1.0::DOUBLE"), leg=code_leg()),
    "lsh_recall": search(queries=QUERIES.replace("0.5::DOUBLE", "1.0::DOUBLE"), leg=code_leg(),
                         final="""SELECT query_id, count(*) AS n_nearest, count(h.doc_id) AS n_found
  FROM exact e LEFT JOIN (SELECT query_id AS qid, doc_id FROM hits) h ON qid = query_id AND h.doc_id = e.doc_id
  WHERE vector_rank <= 10 GROUP BY query_id"""),
    "hybrid_search": search(), "hybrid_rrf": search(fusion="rrf"),
    "hybrid_alphas": search(queries=VARIED),
    "bm25_large_topk": search(queries=ONE_LARGE, vectors=None), "hybrid_large_topk": search(queries=ONE_LARGE),
    "search_filtered": search(allowed="translation_paragraph IS NOT NULL AND book_id LIKE 'src1%'"),
    "search_fallback": search(queries=FALLBACK, vectors=(
        "qsrc AS (SELECT query_id, vector_text FROM q WHERE vector_text IS NOT NULL),\n"
        + hashed("qv", "qsrc", "query_id", "vector_text"))),
    "rerank_overlap": search(kind="conversations", hits=RERANKED_HITS,
                             doc_text="multilingual_concat"),
    "named_vector_search": search(kind="conversations", doc_text="coalesce(pali_paragraph, '')",
                                  queries=QUERIES.replace("0.5::DOUBLE", "1.0::DOUBLE")),
    "nested_results": search(final="""SELECT query_id, query_lang, alpha,
  to_json(list({'rank': CAST(rank AS INT), 'doc_id': doc_id, 'score_type': score_type} ORDER BY rank))::VARCHAR
  AS results FROM hits GROUP BY ALL"""),
    "nested_results_all": search(queries=NOTHING, vectors=None, final="""SELECT q.query_id, q.query_lang,
  count(doc_id) AS n_results, coalesce(string_agg(doc_id, ' ' ORDER BY rank), '') AS doc_ids
  FROM q LEFT JOIN hits USING (query_id) GROUP BY ALL"""),
    "retrieval_quality_short": search(queries=SHORT, more=PASSAGES, final="SELECT * FROM quality"),
    "search_explain": search(final="""SELECT query_id, doc_id, bm25_score::DOUBLE AS bm25_score,
  vector_score::DOUBLE AS vector_score, score::DOUBLE AS hybrid_score FROM hits"""),
    "generator_answers": search(kind="conversations", more=ANSWER_PARTS,
                                final="SELECT query_id, lang, md5(prompt) AS answer FROM answers"),
    "encode_empty_texts": simple("""t AS (SELECT doc_id, CASE WHEN doc_id % 7 > 1 THEN text ELSE '' END AS txt
  FROM documents)""", hashed("v", "t", "doc_id", "txt"),
                                 final="SELECT doc_id, dim, round(x, 6) AS weight FROM v"),
    "ensure_index": simple(corpus(), final=f"""SELECT {uuid5('doc_id')} AS uuid, doc_id,
  md5(multilingual_concat) AS text_md5 FROM corpus"""),
    "compact_index": simple(corpus(), REVISED, postings("final"), final="SELECT term, df FROM df"),
    "extractive_answer": search(kind="conversations", more=ANSWER_PARTS, final=ANSWERS),
    "extractive_answer_documents": search(more=ANSWER_PARTS, final=ANSWERS),
    "answer_nothing_found": search(kind="conversations", queries=NOTHING, vectors=None,
                                   more=ANSWER_PARTS,
                                   final="SELECT query_id, lang, answer, n_citations FROM answers"),
    "rag_prompt": search(kind="conversations", more=ANSWER_PARTS,
                         final="SELECT query_id, lang, prompt FROM answers"),
    "citations": search(kind="conversations", queries=QUERIES.replace("10 AS top_k", "15 AS top_k"),
                        final=f"""SELECT query_id, CAST(rank AS BIGINT) AS rank, doc_id, score, score_type,
  {TAG} || ' · doc=' || doc_id AS hit_label,
  {TAG} || {NL} || coalesce(pali_paragraph, '') || {NL} || coalesce(translation_paragraph, '')
    AS citation_text FROM hits WHERE rank <= 10"""),
    "vector_audit": f"""SELECT {AUDIT_COLUMNS} FROM (SELECT len(embedding) AS d,
  sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS l FROM embeddings)""",
    "index_vector_audit": simple(corpus(), hashed("v", "corpus", "doc_id", "multilingual_concat"),
                                 final=f"""SELECT {AUDIT_COLUMNS} FROM (SELECT doc_id, 768 AS d,
  sqrt(sum(x * x)) AS l FROM v GROUP BY ALL)"""),
    "pair_similarity": simple(corpus("conversations"), NAMED,
                              hashed("v", "named", "doc_id, vector_name", "txt"),
                              final="""SELECT doc_id || '/pali' AS left_id, doc_id || '/en' AS right_id,
  round(coalesce(sum(a.x * b.x), 0), 6) AS similarity FROM corpus
  LEFT JOIN (SELECT * FROM v WHERE vector_name = 'pali') a USING (doc_id)
  LEFT JOIN (SELECT * FROM v WHERE vector_name = 'en') b USING (doc_id, dim) GROUP BY doc_id"""),
    "nearest_other": simple(PAIRS, final="""SELECT query_id AS doc_id, doc_id AS nearest_id, score AS similarity,
  score < 0.99 AS is_distinct FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY score DESC, doc_id) AS rank FROM pairs WHERE query_id <> doc_id) WHERE rank = 1"""),
    "class_similarity": """WITH pairs AS (SELECT a.label, a.label = b.label AS same,
  list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)
SELECT label, (SELECT count(*) FROM embeddings e WHERE e.label = pairs.label) AS n_vectors,
  round(avg(s) FILTER (same), 6) AS mean_same, round(avg(s) FILTER (NOT same), 6) AS mean_other
FROM pairs GROUP BY label""",
    "ranking_audit": search(final="""SELECT query_id, count(*) AS n_hits,
  bool_and(coalesce(score <= p, true)) AS non_increasing, bool_and(score >= 0 AND score <= 1) AS within_unit,
  count(*) <= 10 AS within_top_k FROM (SELECT *, lag(score) OVER (PARTITION BY query_id ORDER BY rank) AS p
  FROM hits) GROUP BY query_id"""),
    "retrieval_quality": search(more=PASSAGES, final="SELECT * FROM quality"),
    "retrieval_summary": search(more=PASSAGES, final="""SELECT count(*) AS n_queries,
  round(avg(hit::INT), 6) AS hit_rate, round(avg(recall), 6) AS mean_recall,
  round(avg(reciprocal_rank), 6) AS mrr FROM quality"""),
    "encode_reuse": simple(corpus(), f"""again AS (SELECT coalesce({nfc("upper(pali)")}, '') || {SEP}
  || coalesce({nfc("tr")}, '') AS multilingual_concat FROM raw)""", final="""SELECT (SELECT count(*) FROM corpus) AS n_vectors,
  (SELECT count(*) FROM corpus) AS n_unit, (SELECT count(*) FROM (SELECT multilingual_concat FROM corpus
  UNION SELECT multilingual_concat FROM again)) AS n_stored"""),
    "wordless_judgments": simple(corpus(), final="""SELECT query_id, doc_id FROM corpus JOIN (SELECT item_id AS query_id,
  regexp_extract(text, '[^\\p{L}\\p{N}\\p{M}]+') AS query FROM benchmark) ON query <> ''
  AND contains(multilingual_concat, query)"""),
    "encode_agreement": simple(corpus(), final="SELECT doc_id, 0.0::DOUBLE AS max_difference FROM corpus"),
}
