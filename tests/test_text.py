"""Column functions that no query covers."""

from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import diff, leftovers, outcomes


def test_words_left_in_a_block(spark):
    rows = [("However, it is", True), ("<p>so <i>however</i> it is</p>", False), ("whatsoever", False), ("NÉANMOINS x", True), ("", False), (None, None)]
    df = spark.createDataFrame(rows, "b string, want boolean")
    got = df.select("b", "want", leftovers.has_any(F.col("b"), ["however", "néanmoins"]).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)
    assert not df.select(leftovers.has_any(F.col("b"), []).alias("x")).where("x").count()


def test_rewritten_sentences(spark):
    rows = [("a good sentence", "a bad one here", True, True), ("", "x", True, False), ("<b>x</b>", "xxxxxxxx", True, False), ("same", "same", False, False), ("x", "a long one", True, False), ("a very much longer one", "short", True, False)]
    df = spark.createDataFrame(rows, "new string, old string, gone boolean, want boolean")
    got = df.select("want", text.leftover_ok(F.col("new"), F.col("old"), F.col("gone")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_prose_length(spark):
    df = spark.createDataFrame([("<p> a <b>bc</b> </p>", 4), ("", 0)], "b string, want int")
    assert all(r["got"] == r["want"] for r in df.select("want", diff.prose_length(F.col("b")).alias("got")).collect())


def test_source_hash(spark):
    assert spark.range(1).select(outcomes.source_hash(F.lit("abc")).alias("h")).first()["h"] == "a9993e364706816aba3e25717850c26c9cd0d89d"


def test_linear_edits(spark):
    from quillspark.operators import splice

    edits = [(4, 6, "X"), (0, 2, "é"), (5, 9, "no"), (9, 9, "+"), (0, 1, "no")]
    df = spark.createDataFrame([("abcdéfghi", edits), ("abc", [])], "t string, e array<struct<start:int,end:int,replacement:string>>")
    got = df.select(splice.applied(F.col("t"), splice.resolved(F.col("e"))).alias("x")).collect()
    assert [r["x"] for r in got] == ["écdXghi+", "abc"]
