"""Queries that go the whole way through files: sources are written and read back, an index is built, opened, renewed and searched.

Benchmark items stand for legal texts, one markdown file for each, and pages for the rows of a policy register in CSV. Everything is
written below the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import chunking, dense, index, runlog
from strandlake.plans import outputs
from strandlake.plans.knowledge_base import KnowledgeBase
from strandlake.plans.table_queries import (
    _CHUNKS,
    _ITEMS,
    _POLICIES,
    SEARCH,
    _article_cases,
    _bm25,
    _items,
    _items_as_chunks,
    _markdown_of,
    _register,
    Query,
    table,
)
from strandlake.schemas import FILES
from strandlake.sources import legal_xhtml
from strandlake.sources.gold import read_gold
from strandlake.sources.markdown import read_markdown, write_markdown
from strandlake.sources.policies import read_policies
from strandlake.staging import scratch

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_BENCH = "SELECT item_id AS doc_id, 'en' AS lang, 'bench' AS source, text FROM benchmark"
_CORPUS = f"""{_CHUNKS.replace("FROM documents", f"FROM ({_BENCH})")}, {_POLICIES},
co0 AS (SELECT 0 AS register, 'doc' || doc_id AS source, block, part, chunk_id, text, body, citation FROM ch
  UNION ALL SELECT 1, 'policy_register', 0, 0, 'policy::' || pid, 'Internal policy ' || pid || ' — ' || title || chr(10) || body, body, pid FROM pol),
co AS (SELECT row_number() OVER (ORDER BY register, source, block, part, chunk_id) - 1 AS ordinal, chunk_id, text, body, citation, CASE WHEN register = 1 THEN 'policy' ELSE 'regulation' END AS kind, source FROM co0)"""


def _found(queries: str, k: int, where: str = "true") -> str:
    """CTEs up to bm(query_id, doc_id, score, rank) over the corpus, whose ordinal is doc_id."""
    return f"{_CORPUS}, {_bm25(queries, where, k).replace('FROM documents', 'FROM (SELECT ordinal AS doc_id, kind AS lang, source, text FROM co)')}"


def _laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _markdown_of(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("en").alias("lang"), F.lit("bench").alias("source")))


def _written_register(spark: SparkSession, sf_dir: str) -> str:
    at = scratch(spark, "register")
    _register(spark, sf_dir).write.option("header", True).option("escape", '"').csv(at)
    return at


def _kb(spark: SparkSession, sf_dir: str) -> KnowledgeBase:
    """Files written, read, chunked, embedded and indexed; the default mode is by words."""
    laws = scratch(spark, "laws")
    write_markdown(_laws(spark, sf_dir), laws)
    return KnowledgeBase.load(spark, laws, _written_register(spark, sf_dir), scratch(spark, "index"), mode="bm25")


# -- sources
_LAW = """'# Law ' || item_id || ' — of documents' || chr(10) || chr(10) || '## Chapter en' || chr(10) || chr(10) || '### Article ' || item_id || ' — Of bench' || chr(10) || chr(10)
|| CASE WHEN item_id % 3 = 0 THEN (item_id % 7) || '. ' ELSE '' END || CASE WHEN item_id % 2 = 0 THEN replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) ELSE coalesce(text, '') END"""


@query(f"SELECT 'doc' || item_id AS source, sha256(regexp_replace({_LAW}, '\\n$', '') || chr(10)) AS value_sha256 FROM benchmark")
def s3_read_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "laws")
    write_markdown(_laws(spark, sf_dir), at)
    return read_markdown(spark, at).select("source", F.sha2("value", 256).alias("value_sha256"))


@query("""SELECT 'P-' || lpad(CAST(page_id AS VARCHAR), 8, '0') AS policy_id, 'Page ' || lpad(CAST(page_id AS VARCHAR), 8, '0') AS title, CASE WHEN page_id % 2 = 0 THEN 'IT' ELSE '' END AS owner,
coalesce(left(url, 40), '') AS summary, true AS whole FROM pages""")
def s4_read_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_policies(spark, _written_register(spark, sf_dir))
    none = F.lit("")
    return read.select(F.trim("policy_id").alias("policy_id"), "title", F.coalesce("owner", none).alias("owner"), F.coalesce("summary", none).alias("summary"), F.col("_corrupt_record").isNull().alias("whole"))


@query("SELECT text AS q, 'law' AS source, least(CAST(item_id % 7 AS VARCHAR), CAST(item_id % 11 AS VARCHAR)) || ',' || greatest(CAST(item_id % 7 AS VARCHAR), CAST(item_id % 11 AS VARCHAR)) AS articles, CASE WHEN item_id % 2 = 0 THEN 'exact' ELSE 'paraphrase' END AS type FROM benchmark")
def s5_read_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases as the one JSON object that such a file is. Those that are paraphrases don't say so."""
    at = scratch(spark, "gold")
    case = F.struct("source", "q", "articles", F.when(F.col("type") == "exact", F.col("type")).alias("type"))
    _article_cases(spark, sf_dir).agg(F.to_json(F.struct(F.collect_list(case).alias("cases"))).alias("value")).write.text(at)
    return read_gold(spark, at).select("q", "source", F.array_join(F.array_sort("articles"), ",").alias("articles"), "type")


def _official(name: str, regions: list[str]) -> str:
    articles = "".join(f'<div id="art_{i}"><p class="oj-ti-art">Article {i}</p><div class="eli-title"><p>{name}</p></div><div id="00{i}.001"><p>1. On {r}.</p></div></div>' for i, r in enumerate(regions, 1))
    return f"<html><body>{articles}</body></html>"


@query("""SELECT CAST(row_number() OVER (PARTITION BY celex ORDER BY r_regionkey) AS VARCHAR) AS number, 'Regions' AS title, '1. On ' || r_name || '.' AS line, s.celex
FROM region, (SELECT unnest(['first', 'cached']) AS celex) s""")
def s1_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document from the service, and again from the cache when the service would have another one. The five regions are its articles."""
    at = scratch(spark, "cache")
    regions = [r[0] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").select("r_name").collect()]
    first = legal_xhtml.fetch(spark, "32024R0001", at, download=lambda _: _official("Regions", regions))
    again = legal_xhtml.fetch(spark, "32024R0001", at, download=lambda _: _official("Others", regions[:1]))
    both = first.withColumn("celex", F.lit("first")).unionByName(again.withColumn("celex", F.lit("cached")))
    return legal_xhtml.parse_documents(both).where("line IS NOT NULL").select("number", "title", "line", "celex")


# -- the index
@query(f"""{_CORPUS} SELECT chunk_id, ordinal, kind, source, CASE WHEN regexp_matches(lower(text), '[a-z0-9]') THEN 1.0::DOUBLE ELSE 0 END AS norm, (SELECT count(*) FROM co) AS n_chunks, 'hashing:char3-5:1024' AS embedder FROM co""")
def k2_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index holds once it is opened: a unit vector for each chunk, with the chunk's metadata, and the manifest."""
    built = _kb(spark, sf_dir).index
    about = index.Index(spark, built.path, dense.HashingEmbedder()).info()
    norm = F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), 6)
    return built.vectors().select(F.col("id").alias("chunk_id"), "ordinal", "kind", "source", norm.alias("norm"), F.lit(about["n_chunks"]).alias("n_chunks"), F.lit(about["embedder"]).alias("embedder"))


@query("""SELECT step, outcome, n_chunks + added AS n_chunks, fresh FROM (SELECT count(*) AS n_chunks FROM benchmark),
(VALUES (1, 'built', 0, true), (2, 'reused', 0, true), (3, 'synced', 0, true), (4, 'built', 0, true), (5, 'built', 0, true), (6, 'built', 1, true)) t(step, outcome, added, fresh)""")
def f9_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index over the items: new, unchanged, with other metadata, with another text, by order, and with one chunk more."""
    built = index.Index(spark, scratch(spark, "index"), dense.HashingEmbedder())
    chunks = _items_as_chunks(spark, sf_dir)
    renamed = chunks.withColumn("chapter", F.lit("Chapter"))
    edited = renamed.withColumn("text", F.concat("text", F.lit(".")))
    more = edited.unionByName(edited.orderBy("ordinal").limit(1).withColumns({"ordinal": F.lit(-1).cast("long"), "chunk_id": F.lit("more")}))
    rows = []
    for i, (state, anew) in enumerate([(chunks, False), (chunks.repartition(3, "chunk_id"), False), (renamed, False), (edited, False), (edited, True), (more, False)], 1):
        outcome = built.refresh(state, anew)
        about = built.info()
        fresh = built.is_fresh(chunking.fingerprint_tree(state).first()[0], about["n_chunks"]) and not built.is_fresh("other", about["n_chunks"])
        rows.append((i, outcome, about["n_chunks"], fresh))
    return spark.createDataFrame(rows, "step int, outcome string, n_chunks long, fresh boolean")


# -- the front
@query(f"{_found(_ITEMS, 5)} SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, citation FROM bm JOIN co ON co.ordinal = bm.doc_id")
def x4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kb(spark, sf_dir).search(_items(spark, sf_dir), 5).select("query_id", "chunk_id", "rank", "citation")


_PAGE_QUERIES = "SELECT page_id AS query_id, 'Page ' || lpad(CAST(page_id AS VARCHAR), 8, '0') || ' of IT' AS q FROM pages WHERE page_id % 20 = 0"


@query(f"{_found(_PAGE_QUERIES, 4, where='lang = ' + repr('policy'))} SELECT query_id, chunk_id, CAST(rank AS INT) AS rank FROM bm JOIN co ON co.ordinal = bm.doc_id")
def x4_search_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where("page_id % 20 = 0")
    asked = pages.select(F.col("page_id").alias("query_id"), F.concat(F.lit("Page "), F.lpad(F.col("page_id").cast("string"), 8, "0"), F.lit(" of IT")).alias("q"))
    return _kb(spark, sf_dir).search_policies(asked).select("query_id", "chunk_id", "rank")


@query(f"""{_found(_ITEMS, 5)} SELECT q.query_id AS seq, 'run' AS run_id, 'search_regulation' AS tool, q.q AS query, coalesce(string_agg(chunk_id, ' ' ORDER BY rank), '') AS chunk_ids
FROM q LEFT JOIN bm USING (query_id) LEFT JOIN co ON co.ordinal = bm.doc_id GROUP BY q.query_id, q.q""")
def x13_logged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's rows, written and read again."""
    _, rows = _kb(spark, sf_dir).logged_search(_items(spark, sf_dir), "run", "search_regulation")
    at = scratch(spark, "log")
    runlog.write(rows, at)
    return runlog.read(spark, at).select("seq", "run_id", "tool", "query", F.array_join("chunk_ids", " ").alias("chunk_ids"))


@query(f"""{_found(f"SELECT 0 AS query_id, '{SEARCH}' AS q", 10)} SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INT) AS rank, chunk_id, citation, replace(left(body, 140), chr(10), ' ') || '…' AS snippet, CAST(rank AS INT) AS bm25_rank FROM bm JOIN co ON co.ordinal = bm.doc_id""")
def k5_hit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs.hit_table(_kb(spark, sf_dir).search(SEARCH, 10)).drop("dense_rank")


@query("""SELECT 'n' || n_nationkey AS run_id, n_name || chr(10) || 'of region ' || n_regionkey AS final_report, 'said in ' || n_name AS transcript, 'notes' || n_nationkey || '.md' AS name, 'Notes on ' || n_name AS content, n_nationkey AS seq,
'ids ' || n_regionkey AS chunk_ids, 0.5::DOUBLE AS grounded_ratio FROM nation""")
def k4_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each nation: report, transcript, log, checks and files as they are read from where they were written."""
    n = table(spark, sf_dir, "nation")
    name, number, region = F.col("n_name"), F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    log = F.array(F.struct(F.col("n_nationkey").cast("long").alias("seq"), F.lit("search_regulation").alias("tool"), name.alias("query"), F.array(F.lit("ids"), region).alias("chunk_ids")))
    file_ = F.struct(F.concat(F.lit("Notes on "), name).alias("content"), F.lit("utf-8").alias("encoding"))
    runs = n.select(
        F.concat(F.lit("n"), number).alias("run_id"),
        F.concat(name, F.lit("\nof region "), region).alias("final_report"),
        F.concat(F.lit("said in "), name).alias("transcript"),
        log.alias("log"),
        F.struct(F.lit(0.5).alias("grounded_ratio")).alias("report"),
        F.create_map(F.concat(F.lit("/root/notes"), number, F.lit(".md")), file_).cast(FILES).alias("files"),
    )
    at = scratch(spark, "outputs")
    outputs.persist(runs, at)
    text = lambda folder: spark.read.text(f"{at}/{folder}", wholetext=True).select("run_id", F.regexp_replace("value", r"\n\z", "").alias(folder))
    logs = spark.read.json(f"{at}/retrieval_log").select("run_id", F.col("seq").cast("int").alias("seq"), F.array_join("chunk_ids", " ").alias("chunk_ids"))
    files = spark.read.text(f"{at}/research_files", wholetext=True).select("run_id", "name", F.regexp_replace("value", r"\n\z", "").alias("content"))
    checks = spark.read.json(f"{at}/citation_report").select("run_id", "grounded_ratio")
    both = text("report").withColumnRenamed("report", "final_report").join(text("transcript"), "run_id")
    return both.join(logs, "run_id").join(files, "run_id").join(checks, "run_id")
