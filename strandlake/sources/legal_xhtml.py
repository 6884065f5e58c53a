"""Official-journal XHTML: fetch with a cache, and parse to article lines.

Parsing depends on the order of mixed content, which no DataFrame reader keeps, so a document is one event stream: a SAX
handler follows it and writes a line when a paragraph ends. Documents are parsed apart from each other in mapInArrow.
"""

from __future__ import annotations

import io
import re
import time
import urllib.error
import urllib.request
import xml.sax
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.schemas import ARTICLE_LINE

# The service's address and the class and id patterns of its documents.
SERVICE = "http://publications.europa.eu/resource/celex/{celex}"
HEADERS = {"Accept": "application/xhtml+xml;q=0.9, text/html;q=0.8", "Accept-Language": "eng", "User-Agent": "strandlake/1 (legal text ingestion)"}
ARTICLE_MARK = "oj-ti-art"
SECTION, SECTION_TITLE, NOTE, TITLE = "oj-ti-section-1", "oj-ti-section-2", "oj-note-tag", "eli-title"
ARTICLE_ID, PARAGRAPH_ID = re.compile(r"art_\d+[a-z]?"), re.compile(r"\d{3}\.\d{3}")
#: Documents whose lines are handed on at once.
SLICE = 64
TITLE_EDGE = " `'‘’"


def _download(celex: str) -> str:
    with urllib.request.urlopen(urllib.request.Request(SERVICE.format(celex=celex), headers=HEADERS), timeout=60) as answer:
        return answer.read().decode("utf-8")


def fetch(spark: SparkSession, celex: str, cache_dir: str, use_cache: bool = True, tries: int = 3, download: Callable[[str], str] = _download, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """celex, xhtml of a document: from the cache folder, else from the service, and then cached.

    Only failures of the connection are tried again, after 1, 2, 4, ... seconds; a body without articles is an error at once.
    """
    path = f"{cache_dir.rstrip('/')}/{celex}.xhtml"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    cached = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if not (use_cache and cached):
        for k in range(tries):
            try:
                body = download(celex)
                break
            except (urllib.error.URLError, TimeoutError) as e:
                if k == tries - 1:
                    raise RuntimeError(f"{celex} could not be fetched: {e}") from e
                wait(2.0**k)
        if ARTICLE_MARK not in body:
            raise ValueError(f"{celex}: no articles in the answer")
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
    whole = spark.read.text(path, wholetext=True).where("value <> ''")
    return whole.select(F.lit(celex).alias("celex"), F.regexp_replace("value", r"\n\z", "").alias("xhtml"))


@dataclass
class _Cell:
    """A table row being read: the label from its first cell and the lines of the others."""

    cells: int = 0
    label: str = ""
    rows: list[str] = field(default_factory=list)
    first: list[str] = field(default_factory=list)
    indent: int = 0


class _Reader(xml.sax.handler.ContentHandler):
    """Writes (number, title, chapter, paragraph id, lines) for each article as the document goes by."""

    def __init__(self) -> None:
        self.articles: list[dict] = []
        self.chapter = self.pending = ""
        self.open: list[tuple[str, str, str]] = []  # element, class, id
        self.text: list[list[str]] = []  # of elements whose text is wanted
        self.muted = 0
        self.article: dict | None = None
        self.out: list[list[str]] = []  # where lines go: the article's part, then rows of tables within each other
        self.depth = 0  # tables
        self.rows: list[_Cell] = []

    # -- events
    def startElement(self, name: str, attrs) -> None:
        name, cls, id_ = name.rpartition(":")[2], attrs.get("class", ""), attrs.get("id", "")
        self.open.append((name, cls, id_))
        if NOTE in cls:
            self.muted += 1
        elif name == "div" and ARTICLE_ID.fullmatch(id_) and self.article is None:
            self.article = {"number": "", "title": "", "chapter": self.chapter, "depth": len(self.open), "loose": [], "paragraphs": []}
            self.out = [self.article["loose"]]
        elif self.article is not None:
            self._start_inside(name, cls, id_)
        elif name == "p" and cls in (SECTION, SECTION_TITLE):
            self.text.append([])

    def _start_inside(self, name: str, cls: str, id_: str) -> None:
        top = len(self.open) == self.article["depth"] + 1
        if name == "div" and top and TITLE in cls:
            self.text.append([])
        elif name == "div" and top and PARAGRAPH_ID.fullmatch(id_):
            self.article["paragraphs"].append([])
            self.out = [self.article["paragraphs"][-1]]
        elif self._in_title():
            pass
        elif name == "tr":
            self.rows.append(_Cell(indent=len(self.rows)))
        elif name == "td" and self.rows:
            self.rows[-1].cells += 1
            self.text.append([]) if self.rows[-1].cells == 1 else self.out.append(self.rows[-1].rows) if self.rows[-1].cells == 2 else None
        elif name == "p":
            self.text.append([])

    def _in_title(self) -> bool:
        at = self.article["depth"]
        return len(self.open) > at and self.open[at][0] == "div" and TITLE in self.open[at][1]

    def characters(self, content: str) -> None:
        if self.text and not self.muted:
            for x in self.text:
                x.append(content)

    def _taken(self) -> str:
        return " ".join("".join(self.text.pop()).split())

    def endElement(self, name: str) -> None:
        name, cls, id_ = self.open[-1]
        if NOTE in cls:
            self.muted -= 1
        elif self.article is None:
            if name == "p" and cls == SECTION:
                text = self._taken()
                if text.upper().startswith("CHAPTER"):
                    self.pending = self.chapter = text
            elif name == "p" and cls == SECTION_TITLE:
                text = self._taken()
                if self.pending:
                    self.chapter, self.pending = f"{self.pending} — {text}", ""
        elif len(self.open) == self.article["depth"]:
            self.articles.append(self.article)
            self.article, self.out = None, []
        else:
            self._end_inside(name, cls, id_)
        self.open.pop()

    def _end_inside(self, name: str, cls: str, id_: str) -> None:
        top = len(self.open) == self.article["depth"] + 1
        if name == "div" and top and TITLE in cls:
            self.article["title"] = self._taken().strip(TITLE_EDGE)
        elif name == "div" and top and PARAGRAPH_ID.fullmatch(id_):
            self.out = [self.article["loose"]]
        elif self._in_title():
            pass
        elif name == "td" and self.rows:
            if self.rows[-1].cells == 1:
                self.rows[-1].label = self._taken()
        elif name == "tr" and self.rows:
            self._end_row(self.rows.pop())
        elif name == "p":
            text = self._taken()
            if top and ARTICLE_MARK in cls:
                self.article["number"] = text.replace("Article", "").strip()
            elif text and self.rows and self.rows[-1].cells == 1:
                self.rows[-1].first.append("  " * self.rows[-1].indent + text)
            elif text:
                self.out[-1].append("  " * len(self.rows) + text)

    def _end_row(self, row: _Cell) -> None:
        """A row of two cells is a point: its label, then the lines, which stand deeper from the second on."""
        if row.cells >= 2:
            self.out.pop()
            pad = "  " * row.indent
            if row.rows:
                self.out[-1].append(f"{pad}{row.label} {row.rows[0].strip()}")
                self.out[-1].extend(row.rows[1:])
        else:
            self.out[-1].extend(row.first)


def parse(xhtml: str) -> list[tuple]:
    """Rows of ARTICLE_LINE of one document. Content outside numbered paragraphs is the article's first paragraph."""
    body = re.sub(r"<!DOCTYPE[^>]*>", "", re.sub(r"^\s*<\?xml[^>]*\?>", "", xhtml), count=1)
    reader = _Reader()
    parser = xml.sax.make_parser()
    parser.setFeature(xml.sax.handler.feature_external_ges, False)
    parser.setContentHandler(reader)
    parser.parse(io.BytesIO(body.encode()))
    rows = []
    for k, a in enumerate(reader.articles):
        paragraphs = [p for p in ([a["loose"]] if a["loose"] else []) + a["paragraphs"] if p]
        for i, lines in enumerate(paragraphs):
            rows.extend((k, a["number"], a["title"], a["chapter"], i, j, line) for j, line in enumerate(lines))
        if not paragraphs:
            rows.append((k, a["number"], a["title"], a["chapter"], None, None, None))
    return rows


def parse_documents(docs: DataFrame, key: str = "celex", column: str = "xhtml") -> DataFrame:
    """key and ARTICLE_LINE columns; an article without content has one row with null places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                found = [parse(x.as_py()) for x in b.column(1)]
                at = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int64())
                columns = zip(*(r for rows in found for r in rows), strict=True) if len(at) else [[]] * len(ARTICLE_LINE)
                types = [pa.int32() if f.dataType.typeName() == "integer" else pa.string() for f in ARTICLE_LINE]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], schema.names)

    schema = T.StructType([docs.schema[key], *ARTICLE_LINE.fields])
    return docs.select(key, column).mapInArrow(run, schema)


def counts(articles: DataFrame, key: str = "celex") -> DataFrame:
    """Articles and paragraphs of each document."""
    paragraph = F.when(F.col("para_ord").isNotNull(), F.struct("article_ord", "para_ord"))
    return articles.groupBy(key).agg(F.count_distinct("article_ord").alias("n_articles"), F.count_distinct(paragraph).alias("n_paragraphs"))


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, article, paragraph, line) to key, articles: the text of each document's articles."""
    ident, now, text, last = [], None, [], ""
    fresh, names = True, None

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ident[0], pa.array(["".join(x if isinstance(x, str) else "\n".join(x) + "\n\n" for x in text)])], [names[0], "articles"])

    for b in batches:
        names = b.schema.names
        for i, (key, a, p, _, number, title, chapter, line) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
            if fresh or key != ident[1]:
                if not fresh:
                    yield made()
                ident, now, text, last, fresh = [b.column(0).slice(i, 1), key], None, [], "", False
            if now is None or a != now[0]:
                known = number is not None and title is not None
                head = f"## {chapter}\n\n" if chapter and chapter != last else ""
                last = chapter or last
                now = (a, None, known)
                if known:
                    text.append(f"{head}### Article {number} — {title}\n\n")
            if p is not None and now[2]:
                if p != now[1]:
                    text.append([])
                    now = (a, p, True)
                if line is not None:
                    text[-1].append(line)
    if not fresh:
        yield made()


def to_markdown(articles: DataFrame, titles: DataFrame, key: str = "celex") -> DataFrame:
    """key, value: the markdown of each document; titles(key, title, fetched). A chapter is written where it changes.

    A document's lines meet once, in their order, so that documents are parsed once.
    """
    order = ["article_ord", "para_ord", "line_ord"]
    rows = articles.select(key, *order, "number", articles["title"].alias("article_title"), "chapter", "line").repartition(key).sortWithinPartitions(key, *order)
    whole = rows.mapInArrow(_written, T.StructType([articles.schema[key], T.StructField("articles", T.StringType())]))
    notice = F.concat(F.lit("> Source: Official Journal of the European Union, CELEX "), F.col(key).cast("string"), F.lit(", fetched on "), F.col("fetched"), F.lit(".\n> Only the Official Journal version is authentic. Articles only.\n\n"))
    value = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), notice, F.regexp_replace("articles", r"\s+\z", ""), F.lit("\n"))
    return whole.join(titles.select(key, "title", "fetched"), key).select(key, value.alias("value"))
