from pyspark.sql import functions as F

from strandlake.functions import text as X
from strandlake.functions import vectors as V


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("r")).first()["r"]


def test_tokens_drop_stop_words_before_folding(spark):
    assert one(spark, X.tokenize, "The Incidents of others, class-3 classes! bus") == ["incident", "other", "class", "3", "classe", "bus"]
    assert one(spark, X.tokenize, None) == [] == one(spark, X.tokenize, "")


def test_white_space_and_lines(spark):
    assert one(spark, X.strip, "  a b \n") == "a b"
    assert one(spark, X.collapse, " a \n b ") == "a b"
    assert one(spark, X.split_lines, "a\r\nb\rc\n\nd e\n") == ["a", "b", "c", "", "d", "e"]
    assert one(spark, X.split_lines, "") == [] == one(spark, X.split_lines, None)


def test_citations(spark):
    text = "a [law::art1::p1] b [law::art2::p3(b)(ii), law::art1::p1; note] [plain] [??::x y] [law::art1::p2.1]"
    assert one(spark, X.citations, text) == ["law::art1::p1", "law::art2::p3", "??::x y", "law::art1::p2.1"]
    assert one(spark, X.cite_points, " law::art2::p3(b)(ii) ") == "(b)(ii)"
    assert one(spark, X.citations, None) == []


def test_small_parsers(spark):
    assert one(spark, X.parse_list, 'Sure:\n["a", "b c", 3]\nbye') == ["a", "b c", "3"]
    assert one(spark, X.parse_list, "- one\n\n* two\n3") == ["one", "two", "3"]
    assert one(spark, X.parse_list, "[broken\n" + "\n".join("- x" for _ in range(9))) == ["[broken", *["x"] * 5]
    assert one(spark, X.strip_brackets, "[law::a] ") == "law::a"
    assert one(spark, X.snippet, "a\nb" * 100) == ("a\nb" * 100)[:140].replace("\n", " ") + "…"
    delays = spark.createDataFrame([("429 Retry in 39.5s", 1), ("503", 3), ("503", 10)], "m string, a int").select(X.retry_delay(F.col("m"), F.col("a")).alias("r")).collect()
    assert [r["r"] for r in delays] == [40.5, 8.0, 60.0]


def test_routes(spark):
    rows = spark.createDataFrame([("Approve it", 0), ("no", 0), ("no", 2), (None, None)], "d string, n int")
    assert [r["r"] for r in rows.select(X.route_after_human(F.col("d"), F.col("n")).alias("r")).collect()] == ["finalize", "revise", "finalize", "revise"]


def test_vectors(spark):
    assert one(spark, V.l2_normalize, [3.0, 4.0], "array<double>") == [0.6, 0.8]
    assert one(spark, V.l2_normalize, [0.0, 0.0], "array<double>") == [0.0, 0.0]
    assert one(spark, V.char_grams, "ab") == ["#ab", "ab#", "#ab#"]
    assert one(spark, V.char_grams, "a") == ["#a#"]
