"""BM25 over any table with an id, a text and an order.

An index is three tables: postings (a row for each term of a document, with its count and the document's length), terms (with
document frequency and idf) and one row of corpus statistics. They are columns of Parquet when kept. Searching is a batch: the
queries' terms go to the documents, which are packed: a row for each document with its wanted terms and their counts, written once
from the token arrays or from the postings of wanted terms. Each task scores its documents against all queries and hands on the k
best of each, so that what is shuffled grows with queries and tasks and not with pairs.

Terms that many documents hold are scored once for all queries that ask for the same ones of them. A query's k best are among the k
best by these alone and the documents that hold one of its rare terms, as no term takes from a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.functions.text import tokenize
from strandlake.operators.best import Best
from strandlake.staging import discard, materialize

# The usual parameters.
K1, B = 1.5, 0.75
#: Scores are rounded to so many digits before they are ranked, as sums of doubles depend on their order.
DIGITS = 9
#: Wanted terms that are sent to the token arrays as one value; with more of them postings are made and joined.
MOST_WANTED = 5_000
#: Terms of queries that are asked in one pass over the documents, about; more queries take more passes.
MOST_ASKED = 500_000
#: A term in so many documents at most is rare.
RARE = 256
#: Pairs of a document's term and a query that are scored at once, about, and documents that are packed at once.
MOST_PAIRS, PACKED_AT_ONCE = 1 << 20, 1_000


@dataclass
class LexicalIndex:
    postings: DataFrame  # id, ordinal, term, tf, dl and the columns kept for filters
    terms: DataFrame  # term, df, idf
    stats: DataFrame  # n_docs, avgdl
    tokens: DataFrame | None = None  # of an index that is not kept: id, ordinal, dl, tokens and the columns kept for filters
    keep: tuple[str, ...] = ()


def tokens_of(docs: DataFrame, id_: str, text: str, ordinal: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, ordinal, dl, tokens, and what is kept."""
    made = docs.select(F.col(id_).alias("id"), F.col(ordinal or id_).alias("ordinal"), *keep, tokenize(F.col(text)).alias("tokens"))
    return made.withColumn("dl", F.size("tokens"))


def postings_of(tokens: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    flat = tokens.select("id", "ordinal", "dl", *keep, F.explode("tokens").alias("term"))
    return flat.groupBy("id", "ordinal", "dl", *keep, "term").agg(F.count("*").alias("tf"))


def counted(tokens: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of postings_of, counted where a document's tokens are. Only where an id has several rows do they meet in a shuffle."""
    if tokens.groupBy("id", "ordinal").count().where("count > 1").limit(1).count():
        return postings_of(tokens, keep)
    columns = ["id", "ordinal", "dl", *keep]
    kept = tokens.select(*columns, "tokens")
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, PACKED_AT_ONCE):
                b = whole.slice(lo, PACKED_AT_ONCE)
                lists = b.column("tokens")
                flat = lists.flatten().dictionary_encode()
                v = max(1, len(flat.dictionary))
                row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                key, tf = np.unique(row * v + flat.indices.to_numpy(zero_copy_only=False), return_counts=True)
                at = pa.array(key // v)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in columns), flat.dictionary.take(pa.array(key % v)), pa.array(tf, pa.int64())], schema.names)

    return kept.mapInArrow(run, schema)


def stats_of(tokens: DataFrame) -> DataFrame:
    """Empty documents count; the mean length of no documents is 0."""
    return tokens.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def terms_of(postings: DataFrame, stats: DataFrame) -> DataFrame:
    n = stats.select("n_docs").scalar()
    return postings.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf(n, F.col("df")))


def build(docs: DataFrame, id_: str, text: str, ordinal: str | None = None, keep: tuple[str, ...] = ()) -> LexicalIndex:
    tokens = tokens_of(docs, id_, text, ordinal, keep)
    postings, stats = postings_of(tokens, keep), stats_of(tokens)
    return LexicalIndex(postings, terms_of(postings, stats), stats, tokens, keep)


def save(index: LexicalIndex, path: str) -> None:
    """Postings of one term lie together, so that a reader skips row groups of others; a term of many documents takes several ranges."""
    # written first, as the bounds of ranges are found from rows that would be made twice
    made = materialize(counted(index.tokens, index.keep) if index.tokens is not None else index.postings, "postings")
    made.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    discard(made)
    index.stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    spark = index.postings.sparkSession
    kept = load(spark, path)
    terms_of(kept.postings, kept.stats).write.mode("overwrite").parquet(f"{path}/terms")


def load(spark, path: str) -> LexicalIndex:
    read = spark.read.parquet
    return LexicalIndex(read(f"{path}/postings"), read(f"{path}/terms") if _exists(spark, f"{path}/terms") else None, read(f"{path}/stats"))


def _exists(spark, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf of queries(query_id, q); a term that is said twice counts twice."""
    flat = queries.select("query_id", F.explode(tokenize(F.col("q"))).alias("term"))
    return flat.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _wanted(index: LexicalIndex, terms: list[str]) -> LexicalIndex:
    """The index of wanted terms alone, from token arrays: the same postings, frequencies and statistics as the whole one has for them."""
    # a list of literals is looked up by hash
    few = index.tokens.withColumn("tokens", F.filter("tokens", lambda t: t.isin(terms)))
    postings = postings_of(few.where(F.size("tokens") > 0), index.keep)
    return LexicalIndex(postings, terms_of(postings, index.stats), index.stats)


def scores(index: LexicalIndex, queries: DataFrame, where: Column | None = None, within: str | None = None) -> DataFrame:
    """query_id, id, ordinal, score of every document that holds a term. where filters what is scored, not what is counted.

    within: a kept column that must equal the query's own column ``within``.
    """
    wanted = query_terms(queries)
    if index.tokens is not None:
        some = [r["term"] for r in wanted.select("term").distinct().limit(MOST_WANTED + 1).collect()]
        if len(some) <= MOST_WANTED:
            index = _wanted(index, sorted(some))
    terms = index.terms.join(wanted.select("term").distinct(), "term", "left_semi").select("term", "idf")
    scored = index.postings if where is None else index.postings.where(where)
    avgdl = index.stats.select("avgdl").scalar()
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.when(avgdl == 0, 1.0).otherwise(avgdl)))
    asked = wanted.join(terms, "term")
    if within:
        asked = asked.join(queries.select("query_id", F.col("within").alias(within)), "query_id")
    joined = scored.join(asked, ["term", *([within] if within else [])])
    found = joined.groupBy("query_id", "id", "ordinal").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * part), DIGITS).alias("score"))
    return found.where("score > 0")


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their rank; equal scores keep the corpus' order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ordinal", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: LexicalIndex, queries: DataFrame, k: int = 10, where: Column | None = None, within: str | None = None) -> DataFrame:
    """query_id, id, ordinal, score, rank: what top gives of scores, without a row for each pair of a query and a document. It is written when this returns."""
    wanted = query_terms(queries)
    if within:
        wanted = wanted.join(queries.select("query_id", F.col("within").alias("__key")).distinct(), "query_id").where("__key IS NOT NULL")
    else:
        wanted = wanted.withColumn("__key", F.lit(""))
    wanted = materialize(wanted.select("query_id", "term", "qtf", "__key"), "asked")
    blocks = -(-wanted.count() // MOST_ASKED) or 1
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [_block(index, wanted.where(block == i) if blocks > 1 else wanted, k, where, within) for i in range(blocks)]
    discard(wanted)
    return top(reduce(DataFrame.unionByName, parts), k)


def _block(index: LexicalIndex, wanted: DataFrame, k: int, where: Column | None, within: str | None) -> DataFrame:
    """query_id, id, ordinal, score of the k best of each query of wanted(query_id, term, qtf, __key), and maybe of more of them."""
    spark, asked = wanted.sparkSession, wanted.orderBy("query_id", "term", "__key").toArrow()
    terms = asked.column("term").unique().sort()
    rows, df, n_docs, avgdl = _packed_tokens(index, terms, where, within) if index.tokens is not None else _packed_postings(index, terms, where, within)
    plan = _Plan(asked, terms, df, n_docs, avgdl, k)
    given = spark.sparkContext.broadcast(plan)
    kept = rows.schema
    schema = T.StructType([T.StructField("slot", T.LongType()), kept["id"], kept["ordinal"], T.StructField("score", T.DoubleType())])
    found = rows.mapInArrow(_scored(given), schema)
    if plan.shared:
        found = top(found.withColumnRenamed("slot", "query_id"), k).drop("rank").withColumnRenamed("query_id", "slot")
    slots = spark.createDataFrame(plan.slots, T.StructType([T.StructField("slot", T.LongType()), wanted.schema["query_id"]]))
    hits = found.join(F.broadcast(slots), "slot").select("query_id", "id", "ordinal", "score")
    if plan.shared:
        hits = hits.groupBy("query_id", "id", "ordinal").agg(F.max("score").alias("score"))
    out = materialize(top(hits, k).drop("rank"), "hits")
    if index.tokens is not None:
        discard(rows)
    given.unpersist()
    return out


_ENTRIES = "t array<int>, tf array<int>, dl array<int>"


def _packed_tokens(index: LexicalIndex, terms: pa.Array, where: Column | None, within: str | None) -> tuple[DataFrame, np.ndarray, int, float]:
    """Documents with their wanted terms; of each term in how many documents it is; the number of documents and their mean length."""
    spark = index.tokens.sparkSession
    given = spark.sparkContext.broadcast(pc.cast(terms, pa.string()))
    kept = index.tokens.select("id", "ordinal", *index.keep, "dl", "tokens")
    schema = T.StructType([f for f in kept.schema.fields if f.name not in ("dl", "tokens")] + T._parse_datatype_string(f"n int, {_ENTRIES}").fields)
    packed = materialize(kept.mapInArrow(_packing(given), schema), "packed")
    given.unpersist()
    names = ["id", "ordinal", *index.keep, "n"]
    n_docs, avgdl, ids = packed.agg(F.count("*"), F.avg("n"), F.count_distinct(F.struct("id", "ordinal"))).first()
    if ids < n_docs:
        # equal rows of a repeated document are one, and their counts are added
        each = packed.select(*names, F.explode(F.arrays_zip("t", "tf")).alias("e")).groupBy(*names, F.col("e.t").alias("t")).agg(F.sum("e.tf").cast("int").alias("tf"))
        each = materialize(each, "postings")
        df = each.groupBy("t").count()
        rows = _gathered(each.withColumnRenamed("n", "dl"), where, within)
        made = materialize(rows, "packed")
        counted = _by_term(df, len(terms))
        discard(each)
        discard(packed)
        return made, counted, n_docs, avgdl
    counted = _by_term(packed.select(F.explode("t").alias("t")).groupBy("t").count(), len(terms))
    passed = packed if where is None else packed.where(where)
    rows = passed.select("id", "ordinal", (F.col(within) if within else F.lit("")).alias("__key"), "t", "tf", "dl").where(F.size("t") > 0)
    return rows, counted, n_docs, avgdl or 0.0


def _by_term(df: DataFrame, n: int) -> np.ndarray:
    out, got = np.zeros(n, np.int64), df.toArrow()
    out[got.column("t").to_numpy()] = got.column("count").to_numpy()
    return out


def _gathered(postings: DataFrame, where: Column | None, within: str | None) -> DataFrame:
    """id, ordinal, __key and entries of postings(id, ordinal, dl, t, tf, ...): what can meet a query in one row."""
    passed = postings if where is None else postings.where(where)
    keyed = passed.select("id", "ordinal", (F.col(within) if within else F.lit("")).alias("__key"), F.struct(*(F.col(c).cast("int").alias(c) for c in ("t", "tf", "dl"))).alias("e"))
    each = keyed.groupBy("id", "ordinal", "__key").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return each.select("id", "ordinal", "__key", *(F.col(f"e.{c}").alias(c) for c in ("t", "tf", "dl")))


def _packed_postings(index: LexicalIndex, terms: pa.Array, where: Column | None, within: str | None) -> tuple[DataFrame, np.ndarray, int, float]:
    spark = index.postings.sparkSession
    numbered = F.broadcast(spark.createDataFrame(pa.table([terms, pa.array(np.arange(len(terms)), pa.int32())], ["term", "t"]), "term string, t int"))
    df = _by_term(index.terms.join(numbered, "term").select("t", F.col("df").alias("count")), len(terms))
    n_docs, avgdl = index.stats.select("n_docs", "avgdl").first()
    return _gathered(index.postings.join(numbered, "term"), where, within), df, n_docs, avgdl


def _packing(given):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, PACKED_AT_ONCE):
                b = whole.slice(lo, PACKED_AT_ONCE)
                tokens, n, v = b.column("tokens"), b.num_rows, max(1, len(given.value))
                code = pc.index_in(tokens.flatten(), value_set=given.value).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(n), tokens.value_lengths().to_numpy(zero_copy_only=False))
                key, tf = np.unique((row * v + code)[code >= 0], return_counts=True)
                row, t = key // v, key % v
                at = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=n))], pa.int32())
                length = b.column("dl")
                lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (t, tf, length.to_numpy(zero_copy_only=False)[row])]
                first = [(name, b.column(name)) for name in b.schema.names if name not in ("dl", "tokens")]
                yield pa.RecordBatch.from_arrays([x for _, x in first] + [length, *lists], [name for name, _ in first] + ["n", "t", "tf", "dl"])

    return run


class _Plan:
    """What a task needs of the queries. Slots are groups of queries with the same common terms, and after them single queries with rare terms.

    lists[c] are of (key, term): where its entries begin, their slots and weights; c is 0 for terms that are scored for slots of
    groups, 1 for rare ones. Where groups would hardly be fewer than queries, every query is a group and no term is rare.
    """

    def __init__(self, asked: pa.Table, terms: pa.Array, df: np.ndarray, n_docs: int, avgdl: float, k: int) -> None:
        self.k, self.avgdl, self.v = k, avgdl or 1.0, max(1, len(terms))
        named = asked.select(["query_id", "__key"]).combine_chunks()
        fresh = np.array([True] * min(1, len(asked)) + [a != b for a, b in zip(*(named.slice(i, max(0, len(asked) - 1)).to_pylist() for i in (1, 0)), strict=True)], bool)
        self.keys = named.column("__key").unique()
        key = pc.index_in(named.column("__key"), value_set=self.keys).to_numpy().astype(np.int64)
        t = pc.index_in(asked.column("term"), value_set=terms).to_numpy().astype(np.int64)
        qtf = asked.column("qtf").to_numpy()
        ids, order = named.column("query_id"), None
        if len(self.keys) > 1:
            # a query may be asked within several keys: rows of one query and key lie together
            ident = np.cumsum(np.r_[False, _changed(ids)]) if len(asked) else np.zeros(0, int)
            order = np.lexsort((t, key, ident))
            key, t, qtf, ids = key[order], t[order], qtf[order], ids.take(pa.array(order))
            fresh = np.r_[True, (ident[order][1:] != ident[order][:-1]) | (key[1:] != key[:-1])]
        query = np.cumsum(fresh) - 1
        of_query = ids.take(pa.array(np.flatnonzero(fresh)))
        n = len(of_query)
        idf_ = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        held = df[t] > 0
        query, key, t, w, qtf = query[held], key[held], t[held], (qtf * idf_[t])[held], qtf[held]
        pair = key * self.v + t
        common = df[t] > RARE
        groups: dict[tuple, int] = {}
        group = np.full(n, -1)
        ends = np.searchsorted(query, np.arange(n + 1))
        for q in range(n):
            s = slice(ends[q], ends[q + 1])
            c = common[s]
            if c.any():
                group[q] = groups.setdefault((*pair[s][c].tolist(), *qtf[s][c].tolist()), len(groups))
        self.shared = len(groups) * 4 <= n and n > 0
        if not self.shared:
            group, common = np.arange(n), np.ones(len(t), bool)
        self.groups, self.group, self.queries = int(group.max(initial=-1)) + 1, group, n
        # of each group the terms of its first query
        first = np.full(self.groups, -1)
        first[group[::-1][group[::-1] >= 0]] = np.arange(n)[::-1][group[::-1] >= 0]
        led = common & (group[query] >= 0)
        led[led] = first[group[query[led]]] == query[led]
        self.lists = [_by_pair(pair[led], group[query[led]], w[led]), _by_pair(pair[~common], query[~common], w[~common])]
        has = group >= 0
        slots, names = np.r_[group[has], self.groups + np.arange(n) if self.shared else []], np.r_[np.flatnonzero(has), np.arange(n) if self.shared else []]
        self.slots = pa.table([pa.array(slots.astype(np.int64)), of_query.take(pa.array(names.astype(np.int64)))], ["slot", "query_id"])


def _changed(ids: pa.ChunkedArray) -> np.ndarray:
    found = ids.to_pylist()
    return np.array([a != b for a, b in zip(found[1:], found, strict=False)], bool)


def _by_pair(pair: np.ndarray, slot: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((slot, pair))
    known, at = np.unique(pair[order], return_index=True)
    return known, np.r_[at, len(pair)].astype(np.int64), slot[order].astype(np.int64), w[order]


def _met(lists, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each code where its entries begin and how many there are."""
    known, at, _, _ = lists
    if not len(known):
        return np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    i = np.minimum(np.searchsorted(known, code), len(known) - 1)
    return at[i], np.where(known[i] == code, at[i + 1] - at[i], 0)


def _spread(lists, begin: np.ndarray, n: np.ndarray, row: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, slot and part of a score for each entry."""
    at = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
    return np.repeat(row, n), lists[2][at], lists[3][at] * np.repeat(c, n)


def _added(cell: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums by cell."""
    known, which = np.unique(cell, return_inverse=True)
    return known, np.bincount(which, value, len(known))


def _scored(given):
    """Documents with entries to the best slots of a task. A rare row's score is that of its group and of the rare terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = given.value
        by_group, by_query = (Best(n, p.k, ("slot", "id", "ordinal", "score")) for n in (p.groups, p.queries))
        for b in batches:
            t = b.column("t")
            size = t.value_lengths().to_numpy(zero_copy_only=False)
            key = pc.index_in(b.column("__key"), value_set=p.keys).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), size)
            code = np.where(key[row] >= 0, key[row] * p.v + t.flatten().to_numpy(), -1)
            tf, dl = (b.column(x).flatten().to_numpy().astype(float) for x in ("tf", "dl"))
            c = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / p.avgdl))
            met = [_met(x, code) for x in p.lists]
            ends = np.cumsum(np.bincount(row, met[0][1] + met[1][1], b.num_rows))
            lo = 0
            while lo < b.num_rows:
                most = (ends[lo - 1] if lo else 0) + MOST_PAIRS
                hi = max(lo + 1, int(np.searchsorted(ends, most, "right")))
                i, j = np.searchsorted(row, [lo, hi])
                _add(p, b, lo, hi, row[i:j], c[i:j], [(x[i:j], n[i:j]) for x, n in met], by_group, by_query)
                lo = hi
        for best, shift in ((by_group, 0), (by_query, p.groups)):
            out = best.table()
            if out is not None:
                out = out.set_column(0, "slot", pc.add(out.column(0), shift))
                yield from out.to_batches(max_chunksize=1 << 16)

    return run


def _add(p: _Plan, b: pa.RecordBatch, lo: int, hi: int, row: np.ndarray, c: np.ndarray, met, by_group: Best, by_query: Best) -> None:
    """Rows lo to hi of a batch."""
    r, slot, part = _spread(p.lists[0], *met[0], row, c)
    cell = (r - lo) * p.groups + slot
    dense = (hi - lo) * p.groups <= max(4 * len(cell), 1 << 16)
    if dense:
        sums = np.bincount(cell, part, (hi - lo) * p.groups)
        known = np.flatnonzero(sums)
        sums_known = sums[known]
    else:
        known, sums_known = _added(cell, part)
    _best_of(by_group, b, lo, known, sums_known, p.groups)
    if p.shared:
        r, query, part = _spread(p.lists[1], *met[1], row, c)
        cell, rare = _added((r - lo) * p.queries + query, part)
        group = p.group[cell % p.queries]
        at = cell // p.queries * p.groups + group
        if dense:
            base = np.where(group >= 0, sums[np.where(group >= 0, at, 0)] if len(sums) else 0.0, 0.0)
        else:
            i = np.minimum(np.searchsorted(known, at), max(0, len(known) - 1))
            base = np.where((group >= 0) & (known[i] == at), sums_known[i], 0.0) if len(known) else np.zeros(len(cell))
        _best_of(by_query, b, lo, cell, base + rare, p.queries)


def _best_of(best: Best, b: pa.RecordBatch, lo: int, cell: np.ndarray, score: np.ndarray, n: int) -> None:
    if not len(cell):
        return
    score = np.round(score, DIGITS)
    slot = cell % n
    good = np.flatnonzero((score > 0) & (score >= best.floor[slot]))
    at = pa.array(lo + cell[good] // n)
    best.add(slot[good], b.column("id").take(at), b.column("ordinal").take(at), score[good])
