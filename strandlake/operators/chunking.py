"""Legal texts to chunks: one for each paragraph of an article, split where it is long, with a header that says where it stands.

Lines carry their article and chapter forward within the document; a block ends at a blank line or a heading. Long
blocks are packed greedily into parts with an ordered fold over their lines. Documents are independent: each is read where its text
is, in one pass and without a shuffle. Windows over lines say the same of a table of lines, and where a source has several texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.text import rstrip, split_lines, strip
from strandlake.schemas import METADATA
from strandlake.staging import discard, materialize

# Sizes in characters, and the forms of headings and numbers.
MOST_CHARS = 2000
MOST_LEAD = 400
ARTICLE = r"^### Article (\S+) — (.*)$"
NUMBERED = r"^(\d+)\.\s"
SENTENCE_END = r"(?<=[.;:])\s+"
DASH = " — "
#: Texts whose blocks are handed on at once.
SLICE = 256


def short_names(lines: DataFrame) -> DataFrame:
    """source, name: the first title line up to its dash, else the source in capitals."""
    title = F.min(F.when(F.startswith("line", F.lit("# ")), F.struct("pos", "line")))
    name = strip(F.split_part(F.substring(title["line"], 3, 1 << 30), F.lit(DASH), F.lit(1)))
    return lines.groupBy("source").agg(F.coalesce(name, F.upper("source")).alias("name"))


def article_lines(lines: DataFrame) -> DataFrame:
    """lines(source, pos, line) to the body lines of articles with their article, chapter and block.

    A heading of a chapter or article, or a blank line, ends a block; other lines with a mark are left out and end none. An
    article is told by its order, so that equal numbers stay apart; its chapter is the one that was open where it began.
    """
    is_chapter, is_article = F.startswith("line", F.lit("## ")), F.col("line").rlike(ARTICLE)
    doc = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumns(
        {
            "art_ord": F.sum(F.when(is_article, 1).otherwise(0)).over(doc),
            "__head": F.last(F.when(is_article, F.struct("pos", "line")), ignorenulls=True).over(doc),
            "__chapter": F.coalesce(F.last(F.when(is_chapter, strip(F.substring("line", 4, 1 << 30))), ignorenulls=True).over(doc), F.lit("")),
            "block": F.sum(F.when(is_chapter | is_article | (strip(F.col("line")) == ""), 1).otherwise(0)).over(doc),
        }
    )
    article = Window.partitionBy("source", "art_ord")
    opened = F.max(F.when(F.col("pos") == F.col("__head.pos"), F.col("__chapter"))).over(article)
    kept = marked.withColumn("chapter", opened).where((F.col("art_ord") > 0) & ~F.startswith("line", F.lit("#")) & ~F.startswith("line", F.lit(">")) & (strip(F.col("line")) != ""))
    head = F.col("__head.line")
    return kept.select("source", "art_ord", "chapter", F.regexp_extract(head, ARTICLE, 1).alias("article"), strip(F.regexp_extract(head, ARTICLE, 2)).alias("article_title"), "block", "pos", rstrip(F.col("line")).alias("line"))


def blocks(body: DataFrame) -> DataFrame:
    """A row for each block with its lines in order."""
    keys = ["source", "art_ord", "chapter", "article", "article_title", "block"]
    return body.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))


_ARTICLE, _NUMBERED = re.compile(ARTICLE, re.ASCII), re.compile(NUMBERED, re.ASCII)
_PLACED = "source string, art_ord long, chapter string, article string, article_title string, block long, lines array<string>, number string, __n long, name string"


def _read(text: str | None) -> tuple[str | None, list[list]]:
    """The name that the first title line gives, and of each block what _PLACED has between source and name."""
    name, chapter, opened, head, block, art_ord, plain = None, "", "", None, 0, 0, 0
    found: list[list] = []
    last = None
    # splitlines and strip know the same line ends and white space as functions.text
    for line in (text or "").splitlines():
        bare = line.strip()
        if not bare:
            block += 1
        elif line[0] == "#":
            if line.startswith("# ") and name is None:
                name = line[2:].split(DASH)[0].strip()
            elif line.startswith("## "):
                chapter = line[3:].strip()
                block += 1
            elif article := _ARTICLE.match(line):
                head, opened, block, art_ord, plain = (article[1], article[2].strip()), chapter, block + 1, art_ord + 1, 0
        elif head is not None and line[0] != ">":
            if last == block:
                found[-1][5].append(line.rstrip())
                continue
            last, number = block, _NUMBERED.match(line)
            plain += number is None
            found.append([art_ord, opened, *head, block, [line.rstrip()], number[1] if number else "", plain])
    return name, found


def _blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split(" ")[0] for f in _PLACED.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.string()]
    for whole in batches:
        for lo in range(0, whole.num_rows, SLICE):
            b = whole.slice(lo, SLICE)
            rows = []
            for source, text in zip(b.column(0), b.column(1), strict=True):
                name, found = _read(text.as_py())
                rows.extend((source.as_py(), *x, name) for x in found)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names)


def text_blocks(texts: DataFrame) -> DataFrame:
    """texts(source, value) to the blocks of each text in order, with number, __n (blocks without a number up to it in its article) and name."""
    if texts.groupBy("source").count().where("count > 1").limit(1).count():
        return _placed(texts.select("source", F.posexplode(split_lines(F.col("value"))).alias("pos", "line")))
    read = texts.select(F.col("source").cast("string"), "value").where("source IS NOT NULL").mapInArrow(_blocks_in, _PLACED)
    return read.withColumn("name", F.coalesce("name", F.upper("source")))


def _placed(lines: DataFrame) -> DataFrame:
    """What text_blocks gives, of lines(source, pos, line) by windows."""
    found = blocks(article_lines(lines)).withColumn("number", F.regexp_extract(F.element_at("lines", 1), NUMBERED, 1))
    article = Window.partitionBy("source", "art_ord").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    unnumbered = F.sum(F.when(F.col("number") == "", 1).otherwise(0)).over(article)
    return found.withColumn("__n", unnumbered).join(short_names(lines), "source")


def wrap_line(line: Column, most: int = MOST_CHARS) -> Column:
    """A line as it is, or where it is too long, cut at ends of sentences so that pieces fit, as far as sentences do."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(acc: Column, s: Column) -> Column:
        full = (acc["buf"] != "") & (F.length(acc["buf"]) + F.length(s) + 1 > most)
        out = F.when(full, F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.when(full, s).otherwise(strip(F.concat(acc["buf"], F.lit(" "), s))).alias("buf"))

    def finish(acc: Column) -> Column:
        return F.when(acc["buf"] != "", F.concat(acc["out"], F.array(acc["buf"]))).otherwise(acc["out"])

    return F.when(F.length(line) <= most, F.array(line)).otherwise(F.aggregate(F.split(line, SENTENCE_END, -1), start, step, finish))


def hard_wrap(lines: Column, most: int = MOST_CHARS) -> Column:
    return F.flatten(F.transform(lines, lambda x: wrap_line(x, most)))


def split_block(lines: Column, most: int = MOST_CHARS, lead_most: int = MOST_LEAD) -> Column:
    """Parts of a block, arrays of lines, filled in order; those after the first repeat the first line if it is short."""
    total = F.aggregate(lines, F.lit(0), lambda s, x: s + F.length(x) + 1)
    first = F.element_at(lines, 1)
    lead = F.when(F.length(first) <= lead_most, first).otherwise("")
    lead_size = F.when(lead != "", F.length(lead) + 1).otherwise(0)
    start = F.struct(F.array().cast("array<array<string>>").alias("parts"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("size"))

    def step(acc: Column, x: Column) -> Column:
        full = (F.size(acc["cur"]) > 0) & (acc["size"] + F.length(x) + 1 > most)
        fresh = F.when(lead != "", F.array(lead, x)).otherwise(F.array(x))
        return F.struct(
            F.when(full, F.concat(acc["parts"], F.array(acc["cur"]))).otherwise(acc["parts"]).alias("parts"),
            F.when(full, fresh).otherwise(F.concat(acc["cur"], F.array(x))).alias("cur"),
            F.when(full, lead_size + F.length(x) + 1).otherwise(acc["size"] + F.length(x) + 1).alias("size"),
        )

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["cur"]) > 0, F.concat(acc["parts"], F.array(acc["cur"]))).otherwise(acc["parts"])

    return F.when(total <= most, F.array(lines)).otherwise(F.aggregate(hard_wrap(lines, most), start, step, finish))


def chunk_regulations(lines: DataFrame) -> DataFrame:
    """lines(source, pos, line) to chunks, with (source, art_ord, block, part) as their place. Names are a small table, one row a document."""
    return _chunked(_placed(lines))


def chunk_texts(texts: DataFrame) -> DataFrame:
    """texts(source, value) to the chunks that chunk_regulations makes of their lines."""
    return _chunked(text_blocks(texts))


def _chunked(placed: DataFrame) -> DataFrame:
    base = F.concat("source", F.lit("::art"), "article", F.when(F.col("number") != "", F.concat(F.lit("::p"), "number")).otherwise(F.concat(F.lit("::s"), F.col("__n").cast("string"))))
    cite = F.concat("name", F.lit(" Art. "), "article", F.when(F.col("number") != "", F.concat(F.lit("("), "number", F.lit(")"))).otherwise(""))
    parts = placed.withColumn("__parts", split_block(F.col("lines"))).withColumns({"base_id": base, "citation": cite, "n_parts": F.size("__parts")})
    each = parts.select("*", F.posexplode("__parts").alias("part", "__lines"))
    body = F.array_join("__lines", "\n")
    header = F.concat("name", F.lit(" — Article "), "article", F.lit(": "), "article_title", F.lit("\n"), "chapter")
    chunk_id = F.when(F.col("n_parts") == 1, F.col("base_id")).otherwise(F.concat("base_id", F.lit("."), (F.col("part") + 1).cast("string")))
    return each.select("art_ord", "block", "part", chunk_id.alias("chunk_id"), F.concat(header, F.lit("\n\n"), body).alias("text"), body.alias("body"), F.lit("regulation").alias("kind"), "source", "citation", "article", "article_title", "chapter")


# The words of a policy's text.
POLICY_OWNER, POLICY_REVIEWED, POLICY_HEAD = "Owner: ", ". Last reviewed: ", "Internal policy "


def chunk_policies(policies: DataFrame) -> DataFrame:
    """A chunk for each row of the register."""
    pid = strip(F.col("policy_id"))
    body = F.concat(F.lit(POLICY_OWNER), F.coalesce("owner", F.lit("")), F.lit(POLICY_REVIEWED), F.coalesce("last_reviewed", F.lit("")), F.lit(".\n"), F.coalesce("summary", F.lit("")))
    text = F.concat(F.lit(POLICY_HEAD), pid, F.lit(" — "), "title", F.lit("\n"), body)
    return policies.select(F.concat(F.lit("policy::"), pid).alias("chunk_id"), text.alias("text"), body.alias("body"), F.lit("policy").alias("kind"), F.lit("policy_register").alias("source"), pid.alias("citation"), F.lit("").alias("article"), F.col("title").alias("article_title"), F.lit("").alias("chapter"))


def corpus(regulations: DataFrame, policies: DataFrame, columns: tuple[str, ...] = ("chunk_id", "text", "body", *METADATA)) -> DataFrame:
    """All chunks with their ordinal: documents by name, in their order, then the register by its ids; with the columns that are asked for.

    The ordinal is the place in the whole order, without gaps: chunks are sorted by (register or not, source, article, block, part, id)
    into ranges, ranges are counted, and a chunk's ordinal is its place in its range and the size of the ranges before. No task sorts or
    holds more than a range, and no number is packed into bits that a large corpus would run out of.
    """
    place = ["__register", "source", "art_ord", "block", "part", "chunk_id"]
    kept = list(dict.fromkeys([*columns, "source", "chunk_id"]))
    first = regulations.select(F.lit(0).alias("__register"), F.col("art_ord").cast("long"), F.col("block").cast("long"), F.col("part").cast("long"), *kept)
    none = F.lit(0).cast("long")
    last = policies.select(F.lit(1).alias("__register"), none.alias("art_ord"), none.alias("block"), none.alias("part"), *kept)
    return with_ordinals(first.unionByName(last), place).select("ordinal", *columns)


def with_ordinals(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with ordinal: 0, 1, 2, ... in the order of columns that tell rows apart."""
    # written first, as the bounds of ranges are found from rows that would be made twice
    made = materialize(rows, "unordered")
    ranged = made.repartitionByRange(*order).sortWithinPartitions(*order)
    # the range in the upper bits, the place in the lower 33; written, as another run would cut other ranges
    numbered = materialize(ranged.withColumn("__n", F.monotonically_increasing_id()), "ordinals")
    discard(made)
    range_, at = F.shiftright("__n", 33), F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))
    split = numbered.withColumns({"__range": range_, "__at": at}).drop("__n")
    sizes = split.groupBy("__range").agg(F.count("*").alias("__k"))  # a row for each range
    before = sizes.select("__range", F.coalesce(F.sum("__k").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return split.join(F.broadcast(before), "__range").withColumn("ordinal", F.col("__before") + F.col("__at")).drop("__range", "__at", "__before")


def metadata(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", *METADATA)


def base_id(chunk_id: Column) -> Column:
    """What the parts of a split chunk have in common."""
    return F.regexp_replace(chunk_id, r"\.\d+$", "")


def changed(column: str, by: str = "source", order: str = "ordinal") -> Column:
    """Whether a column differs from the row before, nulls being equal; the first row differs."""
    before = Window.partitionBy(by).orderBy(order)
    return ~F.col(column).eqNullSafe(F.lag(column).over(before)) | (F.row_number().over(before) == 1)


def outline(chunks: DataFrame) -> DataFrame:
    """source, outline: chapters and their articles, each article once, in order."""
    once = Window.partitionBy("source", "article").orderBy("ordinal")
    seen = chunks.withColumn("__k", F.row_number().over(once)).where("__k = 1")
    entry = F.concat(F.when(changed("chapter"), F.concat(F.lit("\n"), "chapter", F.lit("\n"))).otherwise(""), F.lit("  Article "), "article", F.lit(" — "), "article_title")
    rows = seen.select("source", "ordinal", entry.alias("__e"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "__e"))), lambda x: x["__e"]), "\n")
    return rows.groupBy("source").agg(strip(text).alias("outline"))


def fingerprint(chunks: DataFrame) -> DataFrame:
    """fingerprint: of ids and texts in order, 16 hex digits; of an empty corpus that of the empty string.

    The hash of one ordered string needs all of it in one place; with a corpus beyond one task's memory use fingerprint_tree.
    """
    parts = F.array_sort(F.collect_list(F.struct("ordinal", F.concat("chunk_id", "text").alias("t"))))
    return chunks.agg(F.left(F.sha2(F.array_join(F.transform(parts, lambda x: x["t"]), ""), 256), F.lit(16)).alias("fingerprint"))


def fingerprint_tree(chunks: DataFrame, buckets: int = 4096) -> DataFrame:
    """The same purpose at any size: chunks are hashed where they are, then runs of them in order, then these."""
    return _tree(chunks, F.col("text"), buckets)


def _tree(chunks: DataFrame, value: Column, buckets: int) -> DataFrame:
    """fingerprint of (ordinal, chunk_id, value). Hashes meet by bucket, over as many levels as it takes to have few of them in one place."""
    leaves = chunks.select(F.xxhash64("ordinal", "chunk_id").alias("k"), F.sha2(F.concat_ws("\x1f", F.col("ordinal").cast("string"), "chunk_id", value), 256).alias("h"))
    level, n = leaves, buckets * buckets
    while n >= 1:
        node = F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)
        level = level.groupBy(F.pmod("k", F.lit(n)).alias("k")).agg(node.alias("h"))
        n = n // buckets
    return level.agg(F.left(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)), F.lit(16)).alias("fingerprint"))


def metadata_fingerprint_tree(chunks: DataFrame, buckets: int = 4096) -> DataFrame:
    """meta_fingerprint: the same purpose as metadata_fingerprint at any size."""
    return _tree(chunks, F.to_json(F.struct(*sorted(METADATA))), buckets).withColumnRenamed("fingerprint", "meta_fingerprint")


def metadata_fingerprint(chunks: DataFrame) -> DataFrame:
    """meta_fingerprint: of the filterable columns in order."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", F.to_json(F.struct(*sorted(METADATA))).alias("t"))))
    return chunks.agg(F.left(F.sha2(F.array_join(F.transform(parts, lambda x: x["t"]), ""), 256), F.lit(16)).alias("meta_fingerprint"))


def counts_by_source(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count("*").alias("n_chunks")).orderBy("source")


def regulation_sources(chunks: DataFrame) -> DataFrame:
    return chunks.where("kind = 'regulation'").select("source").distinct().orderBy("source")
