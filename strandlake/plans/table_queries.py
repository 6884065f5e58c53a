"""The engine's operators applied to the driver's tables, each over whole tables, and the SQL that says the same.

Documents stand for legal texts: one markdown file for each, with a title, a chapter (its language) and one article. Citations
are built from ids. Each query returns columns whose names the SQL has too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import text as X
from strandlake.functions import vectors as V
from strandlake.operators import chunking, dense, evaluate, fusion, grounding, lexical, runlog
from strandlake.plans import outputs
from strandlake.sources import legal_xhtml

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SEARCH = "thnt onheed the tiontion anea thnt"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- SQL fragments
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def _tok(text: str) -> str:
    kept = f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda t: t NOT IN ({_STOP}))"
    return f"list_transform({kept}, lambda t: CASE WHEN length(t) > 4 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END)"


_TOKENS = f"toks AS (SELECT doc_id, lang, source, {_tok('text')} AS tk FROM documents)"
_POSTINGS = f"""{_TOKENS},
post AS (SELECT doc_id, lang, source, len(tk) AS dl, term, count(*) AS tf FROM (SELECT doc_id, lang, source, tk, unnest(tk) AS term FROM toks) GROUP BY ALL),
post2 AS (SELECT doc_id, lang, source, dl, term, tf FROM post),
stats AS (SELECT count(*) AS n_docs, avg(len(tk)) AS avgdl FROM toks),
terms AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n_docs FROM stats) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post2 GROUP BY term)"""
# tk is a column of the grouping above and stays out of the sums
_POSTINGS = _POSTINGS.replace("SELECT doc_id, lang, source, len(tk) AS dl, term, count(*) AS tf FROM (SELECT doc_id, lang, source, tk, unnest(tk) AS term FROM toks) GROUP BY ALL", "SELECT doc_id, lang, source, dl, term, count(*) AS tf FROM (SELECT doc_id, lang, source, len(tk) AS dl, unnest(tk) AS term FROM toks) GROUP BY ALL")


def _bm25(queries: str, where: str = "true", k: int = 30) -> str:
    """CTEs up to bm(query_id, doc_id, score, rank)."""
    return f"""{_POSTINGS}, q AS ({queries}),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tok('q')}) AS term FROM q) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM stats)))), 9) AS score
       FROM post2 JOIN qt USING (term) JOIN terms USING (term) WHERE {where} GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= {k})"""


_ONE = f"SELECT 0 AS query_id, '{SEARCH}' AS q"
_ITEMS = "SELECT item_id AS query_id, text AS q FROM benchmark"
# CRC-32 by table: eight steps for each of 256 bytes, then a fold over the bytes of a string
_CRC = """ct AS (WITH RECURSIVE s AS (SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM s WHERE k < 8) SELECT list(c ORDER BY i) AS tab FROM s WHERE k = 8)"""


def _hashed(name: str, rows: str) -> str:
    """CTEs up to {name}(id, b, v): signed counts by bucket of rows(id, text); needs ct."""
    return f"""{name}t AS (SELECT id, tok, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS tok FROM ({rows})) GROUP BY ALL),
{name}g AS (SELECT tok, substr('#' || tok || '#', CAST(i AS BIGINT), n) AS g FROM (SELECT DISTINCT tok FROM {name}t), (SELECT unnest([3, 4, 5]) AS n), range(1, 400) r(i) WHERE i + n - 1 <= length(tok) + 2),
{name}h AS (SELECT g, xor(list_reduce(list_transform(string_split(g, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM (SELECT DISTINCT g FROM {name}g), ct),
{name} AS (SELECT id, h % 1024 AS b, CAST(sum(n * CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END) AS BIGINT) AS v FROM {name}t JOIN {name}g USING (tok) JOIN {name}h USING (g) GROUP BY ALL)"""


def _one_query(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.lit(SEARCH).alias("q"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


def _index(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    return lexical.build(table(spark, sf_dir, "documents"), "doc_id", "text", keep=("lang", "source"))


# -- tokens and BM25
@query(f"WITH {_TOKENS} SELECT doc_id, CAST(len(tk) AS INT) AS n_tokens, sha256(array_to_string(tk, ' ')) AS tokens_sha256 FROM toks")
def c1_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    return made.select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("tokens_sha256"))


@query(f"WITH {_POSTINGS} SELECT doc_id, term, tf, CAST(dl AS INT) AS dl FROM post2")
def a1_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    return lexical.counted(index.tokens, index.keep).select(F.col("id").alias("doc_id"), "term", "tf", "dl")


@query(f"WITH {_POSTINGS} SELECT n_docs, round(avgdl, 9) AS avgdl FROM stats")
def a2_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).stats.select("n_docs", F.round("avgdl", 9).alias("avgdl"))


@query(f"WITH {_POSTINGS} SELECT term, df, round(idf, 9) AS idf FROM terms")
def a3_docfreq_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).terms.select("term", "df", F.round("idf", 9).alias("idf"))


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@query(f"WITH {_bm25(_ONE)} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, score, CAST(rank AS INT) AS rank FROM bm")
def x1_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(lexical.search(_index(spark, sf_dir), _one_query(spark), 30))


_WHERE = "lang = 'en' AND source = 'src3'"


@query(f"WITH {_bm25(_ONE, _WHERE, 10)} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, score, CAST(rank AS INT) AS rank FROM bm")
def x1_bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(lexical.search(_index(spark, sf_dir), _one_query(spark), 10, F.expr(_WHERE)))


@query(f"WITH {_bm25(_ITEMS, k=10)} SELECT query_id, doc_id, score, CAST(rank AS INT) AS rank FROM bm")
def x1_bm25_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(lexical.search(_index(spark, sf_dir), _items(spark, sf_dir), 10))


# -- vectors
_UNIT = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings"


def _knn(where: str = "true", k: int = 10) -> str:
    return f"""WITH e AS ({_UNIT}),
s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.v, e.v), 9) AS score FROM e q, e WHERE q.vec_id % 20 = 0 AND e.{where})
SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"""


def _nearest(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ordinal"), F.col("embedding").alias("v"), "label")
    asked = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), "v")
    return dense.nearest(e, asked, 10, where).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


@query(_knn("vec_id IS NOT NULL"))
def x2_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir)


@query(_knn("label = 3"))
def x2_dense_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, F.col("label") == 3)


@query(f"WITH e AS ({_UNIT}) SELECT vec_id, CAST(len(v) AS INT) AS n, round(sqrt(list_dot_product(v, v)), 6) AS norm, round(v[1], 9) AS first, round(v[-1], 9) AS last FROM e")
def c2_l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.l2_normalize(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.size("v").alias("n"), F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(F.element_at("v", 1), 9).alias("first"), F.round(F.element_at("v", -1), 9).alias("last"))


@query(f"WITH e AS ({_UNIT}) SELECT a.vec_id, b.vec_id AS next_id, round(list_dot_product(a.v, b.v), 9) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def c4_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select("vec_id", F.col("embedding").alias("a")), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", "next_id", F.round(V.cosine(F.col("a"), F.col("b")), 9).alias("cosine"))


@query(f"WITH {_CRC}, {_hashed('d', 'SELECT doc_id AS id, text FROM documents')} SELECT id AS doc_id, b AS bucket, v AS value FROM d WHERE v <> 0")
def c3_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signed counts of each document, folded where its text is; nothing is shuffled. c3_gram_buckets says the same by expressions."""
    return dense.bucket_counts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 1024).withColumnRenamed("id", "doc_id")


@query(f"WITH {_CRC}, {_hashed('i', 'SELECT item_id AS id, text FROM benchmark')} SELECT id AS item_id, b AS bucket, v AS value FROM i WHERE v <> 0")
def c3_gram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket sums by built-in expressions: distinct tokens are cut and hashed once, whatever the number of texts that hold them."""
    tokens = table(spark, sf_dir, "benchmark").select("item_id", F.explode(X.words(F.coalesce("text", F.lit("")))).alias("t")).groupBy("item_id", "t").agg(F.count("*").alias("n"))
    grams = tokens.select("t").distinct().select("t", F.explode(V.char_grams(F.col("t"))).alias("g"))
    buckets = grams.select("t", V.gram_bucket(F.col("g"), 1024).cast("long").alias("bucket"), V.gram_sign(F.col("g")).alias("s")).groupBy("t", "bucket").agg(F.sum("s").alias("s"))
    return tokens.join(buckets, "t").groupBy("item_id", "bucket").agg(F.sum(F.col("n") * F.col("s")).alias("value")).where("value <> 0")


# -- fusion and evaluation
def _retriever(spark: SparkSession, sf_dir: str) -> fusion.Retriever:
    embedder = dense.HashingEmbedder()
    docs = table(spark, sf_dir, "documents")
    vectors = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ordinal"), embedder.documents(F.col("text")).alias("v"))
    return fusion.Retriever(_index(spark, sf_dir), vectors, embedder)


_DENSE = f"""{_CRC}, {_hashed('d', 'SELECT doc_id AS id, text FROM documents')}, {_hashed('i', 'SELECT item_id AS id, text FROM benchmark')},
dn AS (SELECT id, sqrt(sum(v * v)) AS n FROM d GROUP BY id), qn AS (SELECT id, sqrt(sum(v * v)) AS n FROM i GROUP BY id),
dots AS (SELECT i.id AS query_id, d.id AS doc_id, CAST(sum(i.v * d.v) AS DOUBLE) AS dot FROM i JOIN d USING (b) GROUP BY ALL),
alln AS (SELECT i.item_id AS query_id, o.doc_id FROM benchmark i, documents o),
cs AS (SELECT query_id, doc_id, round(coalesce(dot / nullif(qn.n * dn.n, 0), 0), 9) AS s FROM alln LEFT JOIN dots USING (query_id, doc_id) LEFT JOIN qn ON qn.id = query_id LEFT JOIN dn ON dn.id = doc_id),
de AS (SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM cs) WHERE rank <= 30)"""


def _fused(modes: str, k: int) -> str:
    """Up to fu(query_id, doc_id, score, bm25_rank, dense_rank, rank)."""
    parts = {"bm25": "SELECT query_id, doc_id, rank AS br, NULL AS dr FROM bm", "dense": "SELECT query_id, doc_id, NULL AS br, rank AS dr FROM de"}
    rows = " UNION ALL ".join(parts[m] for m in modes.split())
    return f"""WITH {_bm25(_ITEMS)}, {_DENSE}, un AS ({rows}),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + coalesce(br, dr))), 12) AS score, CAST(max(br) AS INT) AS bm25_rank, CAST(max(dr) AS INT) AS dense_rank FROM un GROUP BY ALL),
fu AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm25_rank NULLS LAST, dense_rank NULLS LAST, doc_id) AS INT) AS rank FROM f) WHERE rank <= {k})"""


def _hits(spark: SparkSession, sf_dir: str, mode: str, k: int = 5) -> DataFrame:
    return _retriever(spark, sf_dir).search(_items(spark, sf_dir), k, mode).withColumnRenamed("id", "doc_id")


@query(_fused("bm25 dense", 5) + " SELECT * FROM fu")
def x3_hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "hybrid")


@query(_fused("bm25", 40) + " SELECT * FROM fu")
def x3_mode_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "bm25", 40)


@query(_fused("dense", 40) + " SELECT * FROM fu")
def x3_mode_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, "dense", 40)


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).withColumn("type", F.when(F.length("q") > 120, "long"))


def _first_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir, "bm25", 10).select("query_id", "doc_id", "rank", F.lit("bm25").alias("mode"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return evaluate.first_relevant(_cases(spark, sf_dir), hits.join(texts, "doc_id"), F.contains("text", F.col("q")))


_EVAL = f"""WITH {_bm25(_ITEMS, k=10)},
good AS (SELECT query_id, min(rank) AS r FROM bm JOIN q USING (query_id) JOIN documents d USING (doc_id) WHERE contains(d.text, q.q) GROUP BY ALL),
ev AS (SELECT query_id, CASE WHEN length(q) > 120 THEN 'long' ELSE 'paraphrase' END AS grp, CAST(r AS INT) AS r FROM q LEFT JOIN good USING (query_id))"""


@query(f"""{_EVAL} SELECT coalesce(grp, 'all') AS grp, 'bm25' AS mode, count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_1,
round(avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_3, round(avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_5,
round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM ev GROUP BY GROUPING SETS ((), (grp))""")
def x11_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metrics(_first_ranks(spark, sf_dir))


@query(f"{_EVAL} SELECT query_id, r AS rank FROM ev WHERE r IS NULL OR r > 5")
def f8_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.misses(_first_ranks(spark, sf_dir)).select("query_id", "rank")


# -- chunks
def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markdown_of(table(spark, sf_dir, "documents"))


def _markdown_of(docs: DataFrame) -> DataFrame:
    """A file for each document. Lines are paragraphs of their own in every second one, a paragraph together in the others."""
    text = F.coalesce("text", F.lit(""))
    body = F.when(F.col("doc_id") % 2 == 0, F.replace(text, F.lit("\n"), F.lit("\n\n"))).otherwise(text)
    number = F.when(F.col("doc_id") % 3 == 0, F.concat((F.col("doc_id") % 7).cast("string"), F.lit(". "))).otherwise("")
    ident = F.col("doc_id").cast("string")
    head = F.concat(F.lit("# Law "), ident, F.lit(" — of documents\n\n## Chapter "), "lang", F.lit("\n\n### Article "), ident, F.lit(" — Of "), "source", F.lit("\n\n"))
    return docs.select(F.concat(F.lit("doc"), ident).alias("source"), F.concat(head, number, body).alias("value"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_texts(_markdown(spark, sf_dir))


_LINES = r"""d AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 7) || '. ' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) ELSE coalesce(text, '') END AS t FROM documents),
l AS (SELECT doc_id, ls[i] AS line, i AS pos FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d))),
bl AS (SELECT doc_id, pos, rtrim(line, E' \t\r') AS line, sum(CASE WHEN trim(line, E' \t\r') = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM l),
body AS (SELECT * FROM bl WHERE trim(line, E' \t\r') <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '>'))"""
_BLOCKS = rf"""{_LINES},
b0 AS (SELECT doc_id, block, list(line ORDER BY pos) AS lines, sum(length(line) + 1) AS total FROM body GROUP BY ALL),
b AS (SELECT *, regexp_extract(lines[1], '^(\d+)\.\s', 1) AS number FROM b0)"""
_WRAP = r"""
sent AS (SELECT doc_id, block, j, k, ss[k] AS s, len(ss) AS n FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS k FROM (
  SELECT doc_id, block, j, string_split(regexp_replace(lines[j], '([.;:])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS j FROM b WHERE total > 2000) WHERE length(lines[j]) > 2000))),
wr AS (SELECT doc_id, block, j, k, trim(s) AS buf, 0 AS piece FROM sent WHERE k = 1 UNION ALL
  SELECT s.doc_id, s.block, s.j, s.k, CASE WHEN wr.buf <> '' AND length(wr.buf) + length(s.s) + 1 > 2000 THEN s.s ELSE trim(wr.buf || ' ' || s.s) END,
         wr.piece + CASE WHEN wr.buf <> '' AND length(wr.buf) + length(s.s) + 1 > 2000 THEN 1 ELSE 0 END
  FROM wr JOIN sent s ON s.doc_id = wr.doc_id AND s.block = wr.block AND s.j = wr.j AND s.k = wr.k + 1),
pieces AS (SELECT doc_id, block, j, piece, arg_max(buf, k) AS line FROM wr GROUP BY ALL),
whole AS (SELECT doc_id, block, j, 0 AS piece, lines[j] AS line FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS j FROM b)),
wrapped AS (SELECT w.* FROM whole w JOIN b USING (doc_id, block) WHERE NOT (b.total > 2000 AND length(w.line) > 2000) UNION ALL SELECT * FROM pieces WHERE line <> '')"""
_PARTS = r"""
x AS (SELECT w.doc_id, w.block, w.line, row_number() OVER (PARTITION BY w.doc_id, w.block ORDER BY w.j, w.piece) AS i, b.total, CASE WHEN length(b.lines[1]) <= 400 THEN b.lines[1] ELSE '' END AS lead FROM wrapped w JOIN b USING (doc_id, block)),
pt AS (SELECT doc_id, block, i, line, total, lead, length(line) + 1 AS size, 0 AS part FROM x WHERE i = 1 UNION ALL
  SELECT x.doc_id, x.block, x.i, x.line, x.total, x.lead,
         CASE WHEN x.total > 2000 AND pt.size + length(x.line) + 1 > 2000 THEN CASE WHEN x.lead <> '' THEN length(x.lead) + 1 ELSE 0 END + length(x.line) + 1 ELSE pt.size + length(x.line) + 1 END,
         pt.part + CASE WHEN x.total > 2000 AND pt.size + length(x.line) + 1 > 2000 THEN 1 ELSE 0 END
  FROM pt JOIN x ON x.doc_id = pt.doc_id AND x.block = pt.block AND x.i = pt.i + 1),
parts AS (SELECT doc_id, block, part, CASE WHEN part > 0 AND any_value(lead) <> '' THEN any_value(lead) || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY i) AS body FROM pt GROUP BY doc_id, block, part),
ids AS (SELECT doc_id, block, number, sum(CASE WHEN number = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block) AS u FROM b),
ch AS (SELECT p.*, ids.number, 'doc' || doc_id || '::art' || doc_id || CASE WHEN ids.number <> '' THEN '::p' || ids.number ELSE '::s' || CAST(ids.u AS BIGINT) END
         || CASE WHEN count(*) OVER (PARTITION BY doc_id, block) > 1 THEN '.' || (part + 1) ELSE '' END AS chunk_id,
         'Law ' || doc_id || ' Art. ' || doc_id || CASE WHEN ids.number <> '' THEN '(' || ids.number || ')' ELSE '' END AS citation,
         'Law ' || doc_id || ' — Article ' || doc_id || ': Of ' || d.source || chr(10) || 'Chapter ' || d.lang || chr(10) || chr(10) || body AS text
       FROM parts p JOIN ids USING (doc_id, block) JOIN d USING (doc_id))"""
_CHUNKS = f"WITH RECURSIVE {_BLOCKS}, {_WRAP}, {_PARTS}"


@query(f"WITH {_BLOCKS} SELECT 'doc' || doc_id AS source, CAST(len(lines) AS INT) AS n_lines, sha256(array_to_string(lines, chr(10))) AS lines_sha256, number FROM b")
def p7_block_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.text_blocks(_markdown(spark, sf_dir))
    return found.select("source", F.size("lines").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("lines_sha256"), F.regexp_extract(F.element_at("lines", 1), chunking.NUMBERED, 1).alias("number"))


@query(f"{_CHUNKS} SELECT chunk_id, citation, sha256(text) AS text_sha256, CAST(length(body) AS INT) AS n_chars FROM ch")
def p8_header_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", "citation", F.sha2("text", 256).alias("text_sha256"), F.length("body").alias("n_chars"))


@query(f"{_CHUNKS} SELECT 'doc' || doc_id AS source, CAST(count(*) AS BIGINT) AS n_parts, CAST(max(length(body)) AS INT) AS longest, CAST(sum(length(body)) AS BIGINT) AS n_chars FROM parts GROUP BY doc_id")
def p9_greedy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.text_blocks(_markdown(spark, sf_dir)).select("source", F.explode(chunking.split_block(F.col("lines"))).alias("p"))
    size = F.length(F.array_join("p", "\n"))
    return found.groupBy("source").agg(F.count("*").alias("n_parts"), F.max(size).alias("longest"), F.sum(size).alias("n_chars"))


@query(f"WITH RECURSIVE {_BLOCKS}, {_WRAP} SELECT 'doc' || doc_id AS source, CAST(count(*) AS BIGINT) AS n_lines, CAST(max(length(line)) AS INT) AS longest FROM wrapped GROUP BY doc_id")
def p10_hard_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.text_blocks(_markdown(spark, sf_dir))
    total = F.aggregate("lines", F.lit(0), lambda s, x: s + F.length(x) + 1)
    lines = found.select("source", F.explode(F.when(total <= chunking.MOST_CHARS, F.col("lines")).otherwise(chunking.hard_wrap(F.col("lines")))).alias("x"))
    return lines.groupBy("source").agg(F.count("*").alias("n_lines"), F.max(F.length("x")).alias("longest"))


@query("SELECT doc_id, replace(left(coalesce(text, ''), 140), chr(10), ' ') || '…' AS snippet FROM documents")
def p13_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.coalesce("text", F.lit(""))).alias("snippet"))


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks: a conversation is a text, roles are its chapters and every second turn an article."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("source"), F.col("turn").alias("ordinal"), F.col("role").alias("chapter"), F.floor(F.col("turn") / 2).cast("string").alias("article"), F.concat(F.lit("Turn "), F.col("turn").cast("string")).alias("article_title"))


@query("""WITH o AS (SELECT conv_id, turn, role, CAST(turn // 2 AS VARCHAR) AS a, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn) AS k FROM conversations),
e AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM o WHERE k = 1)
SELECT 'c' || conv_id AS source, sha256(trim(string_agg(CASE WHEN was IS DISTINCT FROM role THEN chr(10) || role || chr(10) ELSE '' END || '  Article ' || a || ' — Turn ' || turn, chr(10) ORDER BY turn), E' \\n')) AS outline_sha256 FROM e GROUP BY conv_id""")
def x5_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.outline(_titles(spark, sf_dir)).select("source", F.sha2("outline", 256).alias("outline_sha256"))


@query("SELECT 'c' || conv_id AS source, turn, coalesce(role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn), true) AS changed FROM conversations")
def w5_change_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _titles(spark, sf_dir).select("source", F.col("ordinal").alias("turn"), chunking.changed("chapter").alias("changed"))


# -- XHTML
def _xhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A legal document for each conversation: a turn is an article, its lines are points."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.split(safe, "\n", -1)
    points = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("<tr><td><p>("), i.cast("string"), F.lit(")</p></td><td><p>"), x, F.lit('<span class="oj-note-tag">9</span></p></td></tr>'))), "")
    article = F.concat(F.lit('<p class="oj-ti-section-1">CHAPTER '), "role", F.lit('</p><div id="art_'), F.col("turn").cast("string"), F.lit('"><p class="oj-ti-art">Article '), F.col("turn").cast("string"), F.lit('</p><div class="eli-title"><p>Title`</p></div><div id="001.001"><table><tbody>'), points, F.lit("</tbody></table></div></div>"))
    return c.groupBy("conv_id").agg(F.concat(F.lit("<html><body>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", article.alias("a")))), lambda x: x["a"]), ""), F.lit("</body></html>")).alias("xhtml"))


_XLINES = r"""xl AS (SELECT conv_id, turn, role, i - 1 AS i, trim(regexp_replace(ls[i], '\s+', ' ', 'g')) AS line FROM (SELECT conv_id, turn, role, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations)))"""


@query(f"WITH {_XLINES} SELECT conv_id, CAST(turn AS VARCHAR) AS number, 'CHAPTER ' || role AS chapter, '(' || i || ') ' || line AS line FROM xl WHERE line <> ''")
def s2_parse_xhtml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal_xhtml.parse_documents(_xhtml(spark, sf_dir), "conv_id").where("line IS NOT NULL").select("conv_id", "number", "chapter", "line")


@query(f"WITH {_XLINES} SELECT conv_id, count(DISTINCT turn) AS n_articles, count(DISTINCT CASE WHEN line <> '' THEN turn END) AS n_paragraphs FROM xl GROUP BY conv_id")
def a17_article_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return legal_xhtml.counts(legal_xhtml.parse_documents(_xhtml(spark, sf_dir), "conv_id"), "conv_id")


@query(rf"""WITH {_XLINES}, a AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations),
b AS (SELECT conv_id, turn, string_agg('(' || i || ') ' || line, chr(10) ORDER BY i) AS p FROM xl WHERE line <> '' GROUP BY ALL),
m AS (SELECT a.conv_id, string_agg(CASE WHEN was IS DISTINCT FROM role THEN '## CHAPTER ' || role || chr(10) || chr(10) ELSE '' END || '### Article ' || a.turn || ' — Title' || chr(10) || chr(10) || coalesce(p || chr(10) || chr(10), ''), '' ORDER BY a.turn) AS t FROM a LEFT JOIN b USING (conv_id, turn) GROUP BY ALL)
SELECT conv_id, sha256('# T' || chr(10) || chr(10) || '> Source: Official Journal of the European Union, CELEX ' || conv_id || ', fetched on 2024-01-01.' || chr(10) || '> Only the Official Journal version is authentic. Articles only.' || chr(10) || chr(10) || rtrim(t, E' \n') || chr(10)) AS markdown_sha256 FROM m""")
def k1_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _xhtml(spark, sf_dir)
    titles = docs.select("conv_id", F.lit("T").alias("title"), F.lit("2024-01-01").alias("fetched"))
    return legal_xhtml.to_markdown(legal_xhtml.parse_documents(docs, "conv_id"), titles, "conv_id").select("conv_id", F.sha2("value", 256).alias("markdown_sha256"))


# -- citations: documents are chunks s::d<id>, those of every third are the parts .1 and .2; texts cite some of them
def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    name = F.concat(F.lit("s::d"), n.cast("string"))
    parts = F.explode(F.when(n % 3 == 0, F.array(F.lit(".1"), F.lit(".2"))).otherwise(F.array(F.lit("")))).alias("p")
    chunks = docs.select("doc_id", "source", "lang", name.alias("base"), parts).select((F.col("doc_id") * 2 + F.when(F.col("p") == ".2", 1).otherwise(0)).alias("ordinal"), F.concat("base", "p").alias("chunk_id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("citation"), F.col("lang").alias("article_title"), F.concat("source", F.col("p")).alias("body"))

    def cite(shift: int, suffix: str = "") -> Column:
        return F.concat(F.lit("s::d"), (n + shift).cast("string"), F.lit(suffix))

    text = F.concat(F.lit("A ["), cite(0), F.lit("], b ["), cite(1, "(b)"), F.lit("; "), cite(0), F.lit(", note] c [x] d ["), cite(1000000), F.lit("] e [?::!"), F.lit("] end [s::d"), n.cast("string"), F.lit(".1]  "))
    texts = docs.select(n.alias("doc"), text.alias("text"))
    read = docs.where(n % 2 == 0).select(n.alias("doc"), F.concat(name, F.when(n % 3 == 0, F.lit(".2")).otherwise("")).alias("chunk_id"))
    return texts, chunks, read


_CITED = r"""ids AS (SELECT doc_id AS n, lang, source FROM documents),
ck AS (SELECT n, lang, 'Doc ' || n AS citation, 's::d' || n || p AS chunk_id, source || p AS body, n * 2 + CASE WHEN p = '.2' THEN 1 ELSE 0 END AS ordinal FROM (SELECT *, unnest(CASE WHEN n % 3 = 0 THEN ['.1', '.2'] ELSE [''] END) AS p FROM ids)),
rd AS (SELECT n AS doc, 's::d' || n || CASE WHEN n % 3 = 0 THEN '.2' ELSE '' END AS chunk_id FROM ids WHERE n % 2 = 0),
ct AS (SELECT n AS doc, unnest([0, 1, 2, 3, 4]) AS pos, unnest(['s::d' || n, 's::d' || (n + 1), 's::d' || (n + 1000000), '?::!', 's::d' || n || '.1']) AS cid FROM ids),
rs AS (SELECT ct.doc, ct.pos, ct.cid, ck.chunk_id, ck.ordinal, ck.citation, ck.lang, ck.body FROM ct LEFT JOIN ck ON ck.chunk_id = ct.cid OR starts_with(ck.chunk_id, ct.cid || '.')),
vf AS (SELECT rs.doc, pos, cid, CASE WHEN count(rs.chunk_id) = 0 THEN 'unknown' WHEN count(rd.chunk_id) > 0 THEN 'verified' ELSE 'not_retrieved' END AS status FROM rs LEFT JOIN rd ON rd.doc = rs.doc AND rd.chunk_id = rs.chunk_id GROUP BY ALL)"""
# joins by prefix test every pair there; equal keys say the same here
_CITED = _CITED.replace("LEFT JOIN ck ON ck.chunk_id = ct.cid OR starts_with(ck.chunk_id, ct.cid || '.')", "LEFT JOIN (SELECT chunk_id AS k, * FROM ck UNION ALL SELECT regexp_replace(chunk_id, '\\.\\d+$', '') AS k, * FROM ck WHERE n % 3 = 0) ck ON ck.k = ct.cid")


@query(f"WITH {_CITED} SELECT doc, CAST(pos AS INT) AS pos, cid FROM ct")
def x7_extract_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.extract(_cited(spark, sf_dir)[0])


@query("SELECT doc_id, 's::d' || doc_id AS cid, '(b)(ii)' AS points FROM documents")
def c5_parse_cite(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.concat(F.lit(" s::d"), F.col("doc_id").cast("string"), F.lit("(b)(ii) "))
    return table(spark, sf_dir, "documents").select("doc_id", X.cite_id(token).alias("cid"), X.cite_points(token).alias("points"))


@query(f"WITH {_CITED} SELECT doc, CAST(pos AS INT) AS pos, cid, chunk_id FROM rs")
def j2_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, chunks, _ = _cited(spark, sf_dir)
    return grounding.resolve(grounding.extract(texts), chunks).select("doc", "pos", "cid", "chunk_id")


@query(f"WITH {_CITED} SELECT doc, CAST(pos AS INT) AS pos, cid, status FROM vf")
def x8_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, chunks, read = _cited(spark, sf_dir)
    return grounding.verify(grounding.extract(texts), chunks, read)


@query(f"WITH {_CITED} SELECT doc, CAST(pos AS INT) AS pos, cid FROM vf WHERE status <> 'verified'")
def u3_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.flagged(x8_verify(spark, sf_dir)).select("doc", "pos", "cid")


@query(f"""WITH {_CITED} SELECT doc, count(*) AS total, round(count(*) FILTER (WHERE status = 'verified') / count(*), 3) AS grounded_ratio,
coalesce(string_agg(cid, ' ' ORDER BY pos) FILTER (WHERE status = 'verified'), '') AS verified, coalesce(string_agg(cid, ' ' ORDER BY pos) FILTER (WHERE status = 'unknown'), '') AS unknown FROM vf GROUP BY doc""")
def a12_grounded_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, chunks, read = _cited(spark, sf_dir)
    made = grounding.report(grounding.verify(grounding.extract(texts), chunks, read), texts)
    return made.select("doc", F.col("total").cast("long").alias("total"), "grounded_ratio", F.array_join("verified", " ").alias("verified"), F.array_join("unknown", " ").alias("unknown"))


@query(f"""WITH {_CITED}, f AS (SELECT doc, chunk_id, min(pos * 10000000000 + ordinal) AS place, any_value(citation) AS citation, any_value(body) AS body FROM rs WHERE chunk_id IS NOT NULL GROUP BY ALL)
SELECT ids.n AS doc, coalesce(string_agg(chunk_id, ' ' ORDER BY place), '') AS chunk_ids, coalesce(string_agg('[' || chunk_id || '] ' || citation || chr(10) || body, chr(10) || chr(10) ORDER BY place), '') AS text FROM ids LEFT JOIN f ON f.doc = ids.n GROUP BY ids.n""")
def x9_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, chunks, _ = _cited(spark, sf_dir)
    return grounding.evidence(texts, chunks).select("doc", F.array_join("chunk_ids", " ").alias("chunk_ids"), "text")


@query(rf"""WITH {_CITED}, lb AS (SELECT vf.*, arg_min(citation, ordinal) AS citation, arg_min(lang, ordinal) AS title FROM vf JOIN rs USING (doc, pos, cid) GROUP BY ALL),
g AS (SELECT doc, max(CASE WHEN pos = 0 THEN l END) AS l0, max(CASE WHEN pos = 1 THEN l END) AS l1, max(CASE WHEN pos = 2 THEN l END) AS l2, max(CASE WHEN pos = 3 THEN l END) AS l3, max(CASE WHEN pos = 4 THEN l END) AS l4
  FROM (SELECT doc, pos, coalesce(citation, cid) || CASE WHEN pos = 1 THEN '(b)' ELSE '' END || CASE WHEN status <> 'verified' THEN ' — unverified' ELSE '' END AS l FROM lb) GROUP BY doc),
s AS (SELECT doc, count(*) AS n, count(*) FILTER (WHERE status = 'verified') AS v, string_agg(CASE WHEN citation IS NULL THEN '- `' || cid || '` — **not found in corpus**' ELSE '- ' || citation || ' — ' || title || ' (`' || cid || '`)' || CASE WHEN status <> 'verified' THEN ' — **cited but never retrieved**' ELSE '' END END || chr(10), '' ORDER BY pos) AS t FROM lb GROUP BY doc)
SELECT doc, sha256('A [' || l0 || '], b [' || l1 || '; ' || l0 || '] c [x] d [' || l2 || '] e [' || l3 || '] end [' || l4 || ']' || chr(10) || chr(10) || '## Sources' || chr(10) || chr(10) || t || chr(10) || '_Citation check: ' || v || '/' || n || ' citations verified against retrieved source text._' || chr(10)) AS rendered_sha256 FROM g JOIN s USING (doc)""")
def x10_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, chunks, read = _cited(spark, sf_dir)
    shown = grounding.render(texts, chunks, grounding.verify(grounding.extract(texts), chunks, read))
    return shown.select("doc", F.sha2("rendered", 256).alias("rendered_sha256"))


@query(f"""WITH {_CITED} SELECT doc, 's::d' || doc AS cid, sha256(string_agg('[' || chunk_id || '] ' || citation || ' — ' || lang || chr(10) || body, chr(10) || chr(10) ORDER BY ordinal)) AS text_sha256 FROM rs WHERE pos = 0 GROUP BY doc""")
def x12_provision(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, chunks, _ = _cited(spark, sf_dir)
    asked = texts.select("doc", F.concat(F.lit("[s::d"), F.col("doc").cast("string"), F.lit("] ")).alias("cid"))
    return grounding.provision(asked, chunks, "doc").select("doc", "cid", F.sha2("text", 256).alias("text_sha256"))


# -- the log: users are runs, events are calls
def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.when(F.col("event_type") == "error", runlog.EVIDENCE_TOOL).when(F.col("event_type") == "view", "get_provision").otherwise("search_regulation")
    ids = F.array(F.concat(F.lit("s::d"), (F.col("event_id") % 97).cast("string")), F.concat(F.lit("s::d"), (F.col("event_id") % 13).cast("string")))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), tool.alias("tool"), F.col("props").alias("query"), ids.alias("chunk_ids"))


_LOG = "lg AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'review_evidence' WHEN 'view' THEN 'get_provision' ELSE 'search_regulation' END AS tool, ['s::d' || event_id % 97, 's::d' || event_id % 13] AS ids FROM events)"


@query(f"WITH {_LOG} SELECT DISTINCT run_id, unnest(ids) AS chunk_id FROM lg WHERE tool <> 'review_evidence'")
def a10_retrieved_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.retrieved(_log(spark, sf_dir))


@query(f"WITH {_LOG} SELECT tool, count(*) * 2 AS n_calls, CAST(sum(len(ids)) * 2 AS BIGINT) AS n_ids FROM lg GROUP BY tool")
def u5_log_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return runlog.append(log, log).groupBy("tool").agg(F.count("*").alias("n_calls"), F.sum(F.size("chunk_ids")).alias("n_ids"))


@query(f"WITH {_LOG} SELECT run_id, count(*) AS n FROM lg WHERE tool <> 'review_evidence' GROUP BY run_id")
def f5_log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).where(F.col("tool") != runlog.EVIDENCE_TOOL).groupBy("run_id").agg(F.count("*").alias("n"))


# -- small operators
@query("SELECT source, count(*) AS n_chunks FROM documents GROUP BY source")
def a9_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.counts_by_source(table(spark, sf_dir, "documents"))


@query("SELECT DISTINCT source FROM documents WHERE lang = 'en'")
def a15_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "regulation").otherwise("policy")
    return chunking.regulation_sources(table(spark, sf_dir, "documents").withColumn("kind", kind))


@query("SELECT left(sha256(coalesce(string_agg('b' || item_id || coalesce(text, ''), '' ORDER BY item_id), '')), 16) AS fingerprint FROM benchmark")
def a13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the benchmark, whose size is that of a legal corpus; fingerprint_tree is for tables without a bound."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ordinal"), F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    return chunking.fingerprint(items)


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN length(text) / 10.0::DOUBLE + 1 ELSE least(pow(2.0::DOUBLE, turn), 60) END AS delay FROM conversations")
def c8_retry_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("429: please Retry in "), (F.length("text") / 10).cast("decimal(20,1)").cast("string"), F.lit("s."))).otherwise("503")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.retry_delay(message, F.col("turn")).alias("delay"))


@query(r"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role || '|' || turn ELSE array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(trim(x, '-* '))), lambda x: x <> '')[1:6], '|') END AS items FROM conversations""")
def c9_parse_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    array = F.concat(F.lit('Here:\n["'), "role", F.lit('", '), F.col("turn").cast("string"), F.lit("]\nDone."))
    lines = F.concat(F.lit("- "), F.replace("text", F.lit("\n"), F.lit("\n* ")))
    made = X.parse_list(F.when(F.col("turn") % 2 == 0, array).otherwise(lines))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(made, "|").alias("items"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' OR turn % 4 >= 2 THEN 'finalize' ELSE 'revise' END AS route FROM conversations")
def c10_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.when(F.col("role") == "user", "Approved, go on").otherwise("please change it")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.route_after_human(decision, F.col("turn") % 4).alias("route"))


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def w8_last_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.col("role").alias("source"), "text")
    return runlog.last_by(messages, "assistant", "conv_id")


@query("SELECT conv_id, turn, trim(replace(text, 'th', ''), E' \\n') AS text FROM conversations")
def c14_without_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.without_token(F.col("text"), "th").alias("text"))


@query("SELECT conv_id, max(CASE WHEN turn = 1 THEN text END) AS content FROM conversations GROUP BY conv_id")
def c12_file_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns are files under various paths; the second one is asked for by its name."""
    path = F.concat(F.when(F.col("conv_id") % 2 == 0, "/root/notes/").otherwise("/"), F.lit("turn"), F.col("turn").cast("string"), F.lit(".md"))
    files = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(path, F.struct(F.col("text").alias("content"), F.lit("utf-8").alias("encoding"))))).alias("files"))
    return files.select("conv_id", outputs.file_text(F.col("files"), "turn1.md").alias("content"))


@query("SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def j9_label_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"), F.lit("en").alias("source"), F.array(F.col("doc_id").cast("string")).alias("articles"))
    known = table(spark, sf_dir, "documents").select(F.col("lang").alias("source"), F.col("doc_id").cast("string").alias("article"))
    return evaluate.unknown_labels(cases, known).select(F.col("query_id").alias("doc_id"))


_TEXT = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_TEXT}) AS text_sha256 FROM documents")
def p1_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.collapse(F.coalesce("text", F.lit(""))), 256).alias("text_sha256"))


@query(f"""{_fused('bm25 dense', 4)} SELECT q.query_id, coalesce(string_agg('[d' || doc_id || '] Doc ' || doc_id || ' — ' || lang || chr(10) || source, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank), 'No matching provisions found.') AS text
FROM q LEFT JOIN fu USING (query_id) LEFT JOIN documents USING (doc_id) GROUP BY q.query_id""")
def p14_format_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _retriever(spark, sf_dir).search(_items(spark, sf_dir), 4)
    ident = F.col("doc_id").cast("string")
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), ident).alias("chunk_id"), F.concat(F.lit("Doc "), ident).alias("citation"), F.col("lang").alias("article_title"), F.col("source").alias("body"))
    return fusion.formatted(_items(spark, sf_dir), hits.join(chunks, "id"))


# -- the corpus: chunks of all documents and a register that has a row for each page
def _register(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.lpad(F.col("page_id").cast("string"), 8, "0")
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.concat(F.lit(" P-"), ident, F.lit(" ")).alias("policy_id"), F.concat(F.lit("Page "), ident).alias("title"), F.when(F.col("page_id") % 2 == 0, "IT").alias("owner"), F.lit("2024-01-02").alias("last_reviewed"), F.substring("url", 1, 40).alias("summary"))


_POLICIES = """pol AS (SELECT page_id, 'P-' || lpad(CAST(page_id AS VARCHAR), 8, '0') AS pid, 'Page ' || lpad(CAST(page_id AS VARCHAR), 8, '0') AS title,
  'Owner: ' || CASE WHEN page_id % 2 = 0 THEN 'IT' ELSE '' END || '. Last reviewed: 2024-01-02.' || chr(10) || coalesce(left(url, 40), '') AS body FROM pages)"""


@query(f"WITH {_POLICIES} SELECT 'policy::' || pid AS chunk_id, pid AS citation, 'Internal policy ' || pid || ' — ' || title || chr(10) || body AS text, body, 'policy' AS kind, 'policy_register' AS source FROM pol")
def p11_policy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_policies(_register(spark, sf_dir)).select("chunk_id", "citation", "text", "body", "kind", "source")


def _corpus(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return chunking.corpus(_chunks(spark, sf_dir), chunking.chunk_policies(_register(spark, sf_dir)), columns)


_CORPUS = f"""{_CHUNKS}, {_POLICIES},
co0 AS (SELECT 0 AS register, 'doc' || doc_id AS source, block, part, chunk_id, text FROM ch UNION ALL SELECT 1, 'policy_register', 0, 0, 'policy::' || pid, 'Internal policy ' || pid || ' — ' || title || chr(10) || body FROM pol),
co AS (SELECT row_number() OVER (ORDER BY register, source, block, part, chunk_id) - 1 AS ordinal, chunk_id, text, CASE WHEN register = 1 THEN 'policy' ELSE 'regulation' END AS kind, source FROM co0)"""


@query(f"{_CORPUS} SELECT ordinal, chunk_id, kind, source FROM co")
def u1_union_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by name and the register after them, numbered through."""
    return _corpus(spark, sf_dir, "chunk_id", "kind", "source")


@query(f"{_CHUNKS} SELECT chunk_id, 'regulation' AS kind, 'doc' || doc_id AS source, citation, CAST(doc_id AS VARCHAR) AS article, 'Of ' || d.source AS article_title, 'Chapter ' || d.lang AS chapter FROM ch JOIN d USING (doc_id)")
def p12_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.metadata(_chunks(spark, sf_dir))


def _items_as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident = F.col("item_id").cast("string")
    empty = F.lit("")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ordinal"), F.concat(F.lit("b"), ident).alias("chunk_id"), F.coalesce("text", empty).alias("text"), F.lit("regulation").alias("kind"), F.lit("bench").alias("source"), F.concat(F.lit("Item "), ident).alias("citation"), ident.alias("article"), empty.alias("article_title"), empty.alias("chapter"))


@query("""SELECT left(sha256(coalesce(string_agg('{"article":"' || item_id || '","article_title":"","chapter":"","citation":"Item ' || item_id || '","kind":"regulation","source":"bench"}', '' ORDER BY item_id), '')), 16) AS meta_fingerprint FROM benchmark""")
def a14_metadata_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.metadata_fingerprint(_items_as_chunks(spark, sf_dir))


@query("""SELECT item_id, 'b' || item_id = 'b' || item_id AS same, true AS moved, true AS renamed, true AS empty FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)""")
def a13_fingerprint_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of any size: the same for the same chunks wherever they lie, another one for any change of text, order or number."""
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    one = lambda rows: chunking.fingerprint_tree(rows).first()[0]
    now, least = one(chunks), table(spark, sf_dir, "benchmark").agg(F.min("item_id").alias("item_id"))
    moved = one(chunks.withColumn("ordinal", F.col("ordinal") + 1)) != now
    renamed = one(chunks.withColumn("text", F.when(F.col("ordinal") % 97 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))) != now
    # as many parts as are read and a few more, so that what one task reads of them is bounded
    dealt = chunks.repartition(5 + chunks.rdd.getNumPartitions(), "chunk_id")
    return least.select("item_id", F.lit(one(dealt) == now).alias("same"), F.lit(moved).alias("moved"), F.lit(renamed).alias("renamed"), F.lit(one(chunks.limit(0)) != now).alias("empty"))


@query("SELECT * FROM (VALUES ('auto', 'hashing:char3-5:1024', 'hybrid'), ('auto', 'remote:m:768', 'dense'), ('bm25', 'remote:m:768', 'bm25'), ('dense', 'hashing:x', 'dense'), ('hybrid', 'remote:m:768', 'hybrid')) t(mode, embedder, resolved)")
def c11_resolve_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [("auto", dense.HashingEmbedder().name), ("auto", "remote:m:768"), ("bm25", "remote:m:768"), ("dense", "hashing:x"), ("hybrid", "remote:m:768")]
    return spark.createDataFrame([(m, e, fusion.resolve_mode(m, e)) for m, e in asked], "mode string, embedder string, resolved string")


@query(f"WITH {_bm25(_ITEMS, k=10)} SELECT query_id, 'd' || doc_id AS chunk_id, CAST(rank AS INT) AS rank FROM bm WHERE doc_id % 3 <> 0")
def f6_dangling_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that no chunk has fall out after the cut to ten, so that fewer are left."""
    hits = lexical.search(_index(spark, sf_dir), _items(spark, sf_dir), 10).select("query_id", F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), "rank")
    chunks = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"))
    return fusion.hydrate(hits, chunks).select("query_id", "chunk_id", "rank")


_CASES = "cases AS (SELECT item_id AS query_id, text AS q, list_sort([CAST(item_id % 7 AS VARCHAR), CAST(item_id % 11 AS VARCHAR)]) AS articles, CASE WHEN item_id % 2 = 0 THEN 'exact' ELSE 'paraphrase' END AS type FROM benchmark)"


def _article_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("query_id")
    return _items(spark, sf_dir).select("query_id", "q", F.lit("law").alias("source"), F.array((i % 7).cast("string"), (i % 11).cast("string")).alias("articles"), F.when(i % 2 == 0, "exact").otherwise("paraphrase").alias("type"))


@query(f"WITH {_bm25(_ITEMS, k=10)}, {_CASES} SELECT query_id, CAST(min(rank) AS INT) AS rank FROM cases LEFT JOIN (SELECT query_id, doc_id, rank FROM bm) b USING (query_id) WHERE doc_id IS NOT NULL AND list_contains(articles, CAST(doc_id % 13 AS VARCHAR)) GROUP BY query_id")
def j7_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit whose article is among those of its case; documents are articles by their number."""
    hits = lexical.search(_index(spark, sf_dir), _items(spark, sf_dir), 10).select("query_id", "rank", (F.col("id") % 13).cast("string").alias("article"), F.lit("bm25").alias("mode"))
    found = evaluate.first_relevant(_article_cases(spark, sf_dir), hits, F.array_contains("articles", F.col("article")))
    return found.where("rank IS NOT NULL").select("query_id", "rank")


def _fused_modes(k: int) -> str:
    """Up to ev(mode, query_id, grp, r) of all three modes."""
    rows = {"bm25": "SELECT query_id, doc_id, rank AS br, NULL AS dr FROM bm", "dense": "SELECT query_id, doc_id, NULL AS br, rank AS dr FROM de"}
    un = " UNION ALL ".join(f"SELECT '{m}' AS mode, * FROM ({rows[x]})" for m, parts in (("bm25", ["bm25"]), ("dense", ["dense"]), ("hybrid", ["bm25", "dense"])) for x in parts)
    return f"""WITH {_bm25(_ITEMS)}, {_DENSE}, {_CASES}, un AS ({un}),
f AS (SELECT mode, query_id, doc_id, round(sum(1.0::DOUBLE / (60 + coalesce(br, dr))), 12) AS score, max(br) AS bm25_rank, max(dr) AS dense_rank FROM un GROUP BY ALL),
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, bm25_rank NULLS LAST, dense_rank NULLS LAST, doc_id) AS rank FROM f) WHERE rank <= {k}),
ok AS (SELECT mode, query_id, min(rank) AS r FROM fu JOIN cases USING (query_id) WHERE list_contains(articles, CAST(doc_id % 13 AS VARCHAR)) GROUP BY ALL),
ev AS (SELECT m.mode, c.query_id, c.type AS grp, ok.r FROM cases c, (SELECT unnest(['bm25', 'dense', 'hybrid']) AS mode) m LEFT JOIN ok ON ok.mode = m.mode AND ok.query_id = c.query_id)"""


@query(f"""{_fused_modes(10)} SELECT coalesce(grp, 'all') AS grp, mode, count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_1,
round(avg(CASE WHEN r <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_3, round(avg(CASE WHEN r <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_5,
round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM ev GROUP BY GROUPING SETS ((mode), (mode, grp))""")
def x11_all_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation as it is run: all cases within the chunks of their source, in three modes, by article."""
    embedder = dense.HashingEmbedder()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("regulation").alias("kind"), F.lit("law").alias("source"), (F.col("doc_id") % 13).cast("string").alias("article"))
    vectors = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ordinal"), embedder.documents(F.col("text")).alias("v"), "kind", "source")
    retriever = fusion.Retriever(lexical.build(docs, "doc_id", "text", keep=("kind", "source")), vectors, embedder)
    return evaluate.metrics(evaluate.run(retriever, _article_cases(spark, sf_dir), docs.withColumnRenamed("doc_id", "chunk_id")))
