"""Citations: extraction, resolution against the corpus, checks against what was retrieved, evidence and rendering.

A cited id names a chunk, or all parts of a split one (``base.1``, ``base.2``). Both are equal joins: on the id, else on the
parts' common base, which lies beside each chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.text import CITE_GROUP, citations, cite_id, cite_points, cite_tokens, rstrip
from strandlake.operators.chunking import base_id

VERIFIED, NOT_RETRIEVED, UNKNOWN = "verified", "not_retrieved", "unknown"
MOST_EVIDENCE = 30
# The words and marks of a rendered report.
SOURCES_HEAD = "\n\n## Sources\n\n"
NEVER_RETRIEVED, NOT_FOUND, UNVERIFIED = " — **cited but never retrieved**", "` — **not found in corpus**", " — unverified"
CHECKED_HEAD, CHECKED_TAIL = "_Citation check: ", " citations verified against retrieved source text._"


def extract(texts: DataFrame, key: str = "doc", column: str = "text") -> DataFrame:
    """key, pos, cid: the ids of each text, once each, by first appearance."""
    return texts.select(key, F.posexplode(citations(F.col(column))).alias("pos", "cid"))


def resolve(cites: DataFrame, chunks: DataFrame) -> DataFrame:
    """cites(..., cid) with chunk_id, ordinal of each chunk that the id means; the exact id wins, unknown ids have nulls."""
    known = chunks.select("chunk_id", "ordinal", base_id(F.col("chunk_id")).alias("__base"))
    wanted = cites.select("cid").distinct()
    exact = wanted.join(known, wanted["cid"] == known["chunk_id"]).select("cid", "chunk_id", "ordinal")
    parts = wanted.join(known.where("chunk_id <> __base"), wanted["cid"] == known["__base"]).select("cid", "chunk_id", "ordinal")
    # the exact id stands before the parts
    both = exact.withColumn("__p", F.lit(0)).unionByName(parts.withColumn("__p", F.lit(1)))
    best = both.withColumn("__m", F.min("__p").over(Window.partitionBy("cid"))).where("__p = __m")
    return cites.join(best.select("cid", "chunk_id", "ordinal"), "cid", "left")


def resolve_prefix(cites: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same for ids whose parts have names of any form: every chunk below ``id.``, by equal joins on each prefix of the chunks' ids."""
    dots = F.split("chunk_id", r"\.", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(dots) - 1), lambda n: F.array_join(F.slice(dots, F.lit(1), n), "."))
    below = chunks.where(F.size(dots) > 1).select("chunk_id", "ordinal", F.explode(prefixes).alias("cid"))
    exact = chunks.select("chunk_id", "ordinal", F.col("chunk_id").alias("cid"))
    both = exact.withColumn("__p", F.lit(0)).unionByName(below.withColumn("__p", F.lit(1))).join(cites.select("cid").distinct(), "cid")
    best = both.withColumn("__m", F.min("__p").over(Window.partitionBy("cid"))).where("__p = __m")
    return cites.join(best.select("cid", "chunk_id", "ordinal"), "cid", "left")


def verify(cites: DataFrame, chunks: DataFrame, retrieved: DataFrame, key: str = "doc") -> DataFrame:
    """key, pos, cid, status. retrieved(key, chunk_id): what each text's run has read; any part that was read will do."""
    found = resolve(cites, chunks).join(retrieved.select(key, "chunk_id").distinct().withColumn("__read", F.lit(True)), [key, "chunk_id"], "left")
    status = F.when(F.count("chunk_id") == 0, UNKNOWN).when(F.max("__read").isNotNull(), VERIFIED).otherwise(NOT_RETRIEVED)
    return found.groupBy(key, "pos", "cid").agg(status.alias("status"))


def report(checked: DataFrame, texts: DataFrame, key: str = "doc") -> DataFrame:
    """One row for each text: its ids by status in order, their number, and the share that is verified (0 without any)."""

    def of(status: str) -> Column:
        kept = F.array_sort(F.collect_list(F.when(F.col("status") == status, F.struct("pos", "cid"))))
        return F.transform(kept, lambda x: x["cid"]).alias(status)

    by = checked.groupBy(key).agg(of(VERIFIED), of(NOT_RETRIEVED), of(UNKNOWN), F.count("*").alias("total"), F.round(F.count_if(F.col("status") == VERIFIED) / F.count("*"), 3).alias("grounded_ratio"))
    none = F.array().cast("array<string>")
    joined = texts.select(key).join(by, key, "left")
    return joined.select(key, *(F.coalesce(c, none).alias(c) for c in (VERIFIED, NOT_RETRIEVED, UNKNOWN)), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("grounded_ratio", F.lit(0.0)).alias("grounded_ratio"))


def flagged(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("status") != VERIFIED)


def evidence(texts: DataFrame, chunks: DataFrame, key: str = "doc", most: int = MOST_EVIDENCE) -> DataFrame:
    """key, chunk_ids, text: the source of what each text cites, each chunk once, in order of citation, at most so many."""
    real = resolve(extract(texts, key), chunks).where("chunk_id IS NOT NULL")
    first = real.groupBy(key, "chunk_id").agg(F.min(F.struct("pos", "ordinal")).alias("at"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("at", "chunk_id"))).where(F.col("n") <= most)
    block = F.concat(F.lit("["), "chunk_id", F.lit("] "), "citation", F.lit("\n"), "body")
    shown = ranked.join(chunks.select("chunk_id", "citation", "body"), "chunk_id").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", "chunk_id", block.alias("b")))).alias("__e"))
    none = F.array().cast("array<string>")
    joined = texts.select(key).join(shown, key, "left")
    return joined.select(key, F.coalesce(F.transform("__e", lambda x: x["chunk_id"]), none).alias("chunk_ids"), F.coalesce(F.array_join(F.transform("__e", lambda x: x["b"]), "\n\n"), F.lit("")).alias("text"))


def provision(wanted: DataFrame, chunks: DataFrame, key: str = "query_id") -> DataFrame:
    """key, cid, chunk_ids, text of asked ids (in brackets or not), all parts in order; null text where there is none."""
    asked = wanted.select(key, F.btrim("cid", F.lit("[] ")).alias("cid"))
    found = resolve(asked, chunks).join(chunks.select("chunk_id", "citation", "article_title", "body"), "chunk_id", "left")
    head = F.concat(F.lit("["), "chunk_id", F.lit("] "), "citation", F.when(F.col("article_title") != "", F.concat(F.lit(" — "), "article_title")).otherwise(""))
    parts = F.array_sort(F.collect_list(F.when(F.col("chunk_id").isNotNull(), F.struct("ordinal", "chunk_id", F.concat(head, F.lit("\n"), "body").alias("t")))))
    return found.groupBy(key, "cid").agg(F.transform(parts, lambda x: x["chunk_id"]).alias("chunk_ids"), F.transform(parts, lambda x: x["t"]).alias("__t")).select(key, "cid", "chunk_ids", F.when(F.size("__t") > 0, F.array_join("__t", "\n\n")).alias("text"))


def _pieces(text: Column) -> Column:
    """A text cut before and after each citation group: plain, group, plain, ..., plain. \x00 marks the cuts."""
    return F.split(F.regexp_replace(text, CITE_GROUP, "\x00$1\x00"), "\x00", -1)


def render(texts: DataFrame, chunks: DataFrame, checked: DataFrame, key: str = "doc") -> DataFrame:
    """key, rendered: groups become citations for readers, failed ones are marked, and a list of sources and a count follow.

    A group's labels are looked up by id in a map that lies beside each text, so that text is rewritten where it is.
    """
    real = resolve(checked.select(key, "pos", "cid", "status"), chunks)
    first = real.groupBy(key, "pos", "cid", "status").agg(F.min(F.when(F.col("chunk_id").isNotNull(), F.struct("ordinal", "chunk_id"))).alias("__f"))
    named = first.withColumn("chunk_id", F.col("__f.chunk_id")).join(chunks.select("chunk_id", "citation", "article_title"), "chunk_id", "left")
    label = F.coalesce("citation", "cid")
    title = F.when(F.coalesce("article_title", F.lit("")) != "", F.concat(F.lit(" — "), "article_title")).otherwise("")
    status = F.when(F.col("status") != VERIFIED, NEVER_RETRIEVED).otherwise("")
    entry = F.when(F.col("citation").isNull(), F.concat(F.lit("- `"), "cid", F.lit(NOT_FOUND))).otherwise(F.concat(F.lit("- "), "citation", title, F.lit(" (`"), "cid", F.lit("`)"), status))
    by = named.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("cid", F.struct(label.alias("label"), (F.col("status") != VERIFIED).alias("failed"))))).alias("__m"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))), lambda x: F.concat(x["e"], F.lit("\n"))), "").alias("__s"),
        F.count_if(F.col("status") == VERIFIED).alias("__v"),
        F.count("*").alias("__n"),
    )
    rows = texts.select(key, F.coalesce("text", F.lit("")).alias("text")).join(by, key, "left")

    def labelled(token: Column) -> Column:
        found = F.element_at("__m", cite_id(token))
        return F.concat(found["label"], cite_points(token), F.when(found["failed"], UNVERIFIED).otherwise(""))

    def piece(x: Column, i: Column) -> Column:
        labels = F.array_distinct(F.transform(cite_tokens(x), labelled))
        return F.when(i % 2 == 0, x).when(F.size(labels) > 0, F.concat(F.lit("["), F.array_join(labels, "; "), F.lit("]"))).otherwise(F.concat(F.lit("["), x, F.lit("]")))

    body = F.when(F.col("__m").isNull(), F.col("text")).otherwise(F.array_join(F.transform(_pieces(F.col("text")), piece), ""))
    counted = F.concat(F.lit(CHECKED_HEAD), F.coalesce("__v", F.lit(0)).cast("string"), F.lit("/"), F.coalesce("__n", F.lit(0)).cast("string"), F.lit(CHECKED_TAIL))
    return rows.select(key, F.concat(rstrip(body), F.lit(SOURCES_HEAD), F.coalesce("__s", F.lit("")), F.lit("\n"), counted, F.lit("\n")).alias("rendered"))
