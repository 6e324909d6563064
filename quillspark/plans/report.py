"""Aggregates over outcomes, logs and configuration layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import dims

LAYERS = ("defaults", "user", "book", "env")


def precedence(settings: DataFrame) -> DataFrame:
    """``(key, value, layer)``: the highest layer with a non-empty value wins.

    ``settings (layer, key, value)``; unknown keys are left out, and
    ``dest_code`` always follows the target language.
    """
    from quillspark.functions.text import lang_code

    rank = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    known = settings.where(F.col("key").isin(*dims.DEFAULTS)).where("coalesce(value, '') <> ''").withColumn("rank", rank)
    won = known.groupBy("key").agg(F.max_by(F.struct("value", "layer"), "rank").alias("w")).select("key", "w.value", "w.layer")
    code = won.where("key = 'target_lang'").select(F.lit("dest_code").alias("key"), lang_code(F.col("value")).alias("value"), "layer")
    return won.where("key <> 'dest_code'").unionByName(code)


def log_summary(records: DataFrame) -> DataFrame:
    """One row: attempts, average score without nulls (rounded down), tokens."""
    return records.agg(F.count("*").alias("attempts"), F.floor(F.sum("score") / F.nullif(F.count("score"), F.lit(0))).cast("long").alias("avg_score"), F.sum(F.coalesce("completion_tokens", F.lit(0))).cast("long").alias("tokens"))


def models(records: DataFrame) -> DataFrame:
    """Distinct models of each book, sorted."""
    return records.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


def judged(scores: DataFrame, low: int = 7) -> DataFrame:
    """Average of judged files and how many are below ``low``."""
    return scores.agg(F.avg("score").alias("avg_score"), F.count_if(F.col("score") < low).alias("n_low"))


def judged_low(scores: DataFrame, key: str = "rel", low: int = 7) -> DataFrame:
    """``(key, score, comment)`` of the files below ``low``."""
    return scores.where(F.col("score") < low).select(key, "score", "comment")


def measured(results: DataFrame) -> DataFrame:
    """One row: units, shares valid at once and in the end, calls and characters a second.

    ``results`` are those of :func:`quillspark.operators.client.measure_documents`.
    """
    n, good = F.count("*"), F.col("status") == "ok"
    speed = F.sum("chars") / F.nullif(F.sum("seconds"), F.lit(0.0))
    return results.agg(n.alias("units"), (F.count_if(good & (F.col("attempts") == 1)) / n).alias("first"), (F.count_if(good) / n).alias("final"), F.sum("calls").alias("calls"), F.sum("chars").alias("chars"), speed.alias("chars_per_s"))


def refusals(results: DataFrame) -> DataFrame:
    """``(reason, n)``: how often answers were refused for what, numbers and names taken out."""
    each = results.select(F.explode("refusals").alias("reason"))
    kind = F.regexp_replace(F.regexp_replace("reason", r"<[^>]*>|'[^']*'|“[^”]*”", "_"), r"\d+", "0")
    return each.select(kind.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def books(spine: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """``(slug, files, n_done, n_failed)`` of every book; each file counts once."""
    flag = lambda df, name: df.select("slug", "rel").distinct().withColumn(name, F.lit(True))
    all_files = spine.select("slug", "rel").distinct().join(flag(done, "d"), ["slug", "rel"], "left").join(flag(failed, "f"), ["slug", "rel"], "left")
    return all_files.groupBy("slug").agg(F.count("*").alias("files"), F.count("d").alias("n_done"), F.count("f").alias("n_failed"))


def log_lines(records: DataFrame) -> DataFrame:
    """Records as lines for people: time, file, status, then what else is known."""
    rest = F.concat_ws(" ", F.when(F.col("score").isNotNull(), F.concat(F.lit("score="), "score")), F.when(F.col("model").isNotNull(), F.concat(F.lit("model="), "model")))
    return records.select(F.concat_ws(" ", F.concat(F.lit("["), "ts", F.lit("]")), "file", "status", rest).alias("line"))
