"""Types of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType())}


def _struct(text: str) -> T.StructType:
    """Without a session, which parsing of DDL would need."""
    return T.StructType([T.StructField(n, _KINDS[k]) for n, k in (x.split() for x in text.split(", "))])


#: A unit of retrieval. ordinal is its place in the corpus, which decides ties and fingerprints.
CHUNK = _struct("ordinal long, chunk_id string, text string, body string, kind string, source string, citation string, article string, article_title string, chapter string")
METADATA = ("kind", "source", "citation", "article", "article_title", "chapter")
#: A parsed line of a legal document.
ARTICLE_LINE = _struct("article_ord int, number string, title string, chapter string, para_ord int, line_ord int, line string")
QUERY = _struct("query_id long, q string")
HIT = _struct("query_id long, chunk_id string, score double, rank int, bm25_rank int, dense_rank int")
LOG = _struct("run_id string, seq long, tool string, query string, chunk_ids array<string>")
MANIFEST = _struct("fingerprint string, meta_fingerprint string, embedder string, built_at string, n_chunks long, version string")
GOLD = _struct("source string, q string, articles array<string>, type string")
POLICY = _struct("policy_id string, title string, owner string, last_reviewed string, summary string, _corrupt_record string")
FILES = "map<string,struct<content:string,encoding:string>>"
