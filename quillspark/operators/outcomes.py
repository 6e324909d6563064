"""The outcome store: rows are only ever appended, views say what holds now.

An outcome is ``(rel, idx, orig_hash, status, reason, text, seq)``; status is
``ok``, ``fail`` or ``drop`` (a tombstone).  ``seq`` orders the outcomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "rel string, idx int, orig_hash string, status string, reason string, text string, seq long"


def source_hash(text: Column) -> Column:
    """SHA-1 of the source: another source makes old outcomes void."""
    return F.sha1(text)


def latest(log: DataFrame, keys: tuple[str, ...] = ("rel", "idx")) -> DataFrame:
    """The newest outcome of each unit, tombstones left out."""
    newest = F.max_by(F.struct(*[c for c in log.columns if c not in keys]), "seq").alias("r")
    return log.groupBy(*keys).agg(newest).select(*keys, "r.*").where("status <> 'drop'")


def attempts(log: DataFrame) -> DataFrame:
    """``(rel, idx, attempts)``: outcomes in a row for the present source.

    A changed source, or a tombstone, starts the count again.
    """
    w = Window.partitionBy("rel", "idx").orderBy("seq")
    fresh = ~F.lag("orig_hash").over(w).eqNullSafe(F.col("orig_hash")) | (F.coalesce(F.lag("status").over(w), F.lit("")) == "drop")
    runs = log.withColumn("run", F.sum(fresh.cast("int")).over(w))
    per_run = runs.where("status <> 'drop'").groupBy("rel", "idx", "run").agg(F.count("*").alias("n"))
    return per_run.groupBy("rel", "idx").agg(F.max_by("n", "run").alias("attempts"))


def valid_for(log: DataFrame, sources: DataFrame) -> DataFrame:
    """Latest outcomes whose source is still ``sources (rel, orig)``."""
    now = sources.select("rel", source_hash(F.col("orig")).alias("orig_hash"))
    return latest(log).join(now, ["rel", "orig_hash"])


def unit_status(log: DataFrame) -> DataFrame:
    return latest(log).groupBy("rel").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"))


def failed_units(log: DataFrame, most: int = 8) -> DataFrame:
    """The first failing units of each file, with attempts and reason."""
    w = Window.partitionBy("rel").orderBy("idx")
    bad = latest(log).where("status <> 'ok'").join(attempts(log), ["rel", "idx"])
    ranked = bad.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.select("rel", "idx", "attempts", F.coalesce("reason", F.lit("")).alias("reason"))


def pending(log: DataFrame) -> DataFrame:
    return latest(log).where("status = 'fail'").select("rel").distinct()


def plan_pass(spine: DataFrame, done: DataFrame, waiting: DataFrame, failing: DataFrame) -> DataFrame:
    """``(rel, pos, action)``: files to translate, and to repair.

    ``translate``: neither done nor waiting.  ``repair``: waiting, or done and
    no longer passing.
    """
    known = done.select("rel").union(waiting.select("rel")).distinct()
    new = spine.join(known, "rel", "left_anti").withColumn("action", F.lit("translate"))
    again = waiting.select("rel").union(done.select("rel").join(failing.select("rel"), "rel", "left_semi")).distinct()
    return new.unionByName(spine.join(again, "rel", "left_semi").withColumn("action", F.lit("repair")))


def requeue(done: DataFrame, rels: DataFrame, spine: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays done, which files are queued, and which aren't in the spine."""
    queued, unknown = rels.join(spine.select("rel"), "rel", "left_semi"), rels.join(spine.select("rel"), "rel", "left_anti")
    return done.join(queued.select("rel"), "rel", "left_anti"), queued, unknown


def retry_budget(history: DataFrame, retries: int = 2) -> DataFrame:
    """Adds whether a unit has given up, and the calls it has left."""
    n = F.coalesce("attempts", F.lit(0))
    left = F.greatest(F.lit(0), retries - F.greatest(F.lit(0), n - 1))
    return history.withColumns({"gave_up": n > retries, "left": F.when(n > retries, 0).otherwise(left)})


def state(log: DataFrame) -> DataFrame:
    """``(rel, done, reason)``: a row for each file, with the reason of its last failing unit.

    A file is done if all of its units are good.
    """
    files = latest(log).groupBy("rel").agg(F.bool_and(F.col("status") == "ok").alias("done"), F.max_by("reason", F.when(F.col("status") != "ok", F.col("seq"))).alias("reason"))
    return files.select("rel", "done", F.when(~F.col("done"), F.col("reason")).alias("reason"))


def dropped(log: DataFrame, rels: DataFrame, seq: int) -> DataFrame:
    """Tombstones for all units of ``rels (rel)``, to be appended to the log."""
    now = latest(log).join(rels.select("rel").distinct(), "rel", "left_semi")
    return now.select("rel", "idx", "orig_hash", F.lit("drop").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("text"), F.lit(seq).cast("long").alias("seq"))


def read_original(originals: DataFrame, targets: DataFrame) -> DataFrame:
    """``(rel, orig)``: the untouched original, or the present text where none was kept."""
    return targets.join(originals.withColumnRenamed("text", "kept"), "rel", "left").select("rel", F.coalesce("kept", "text").alias("orig"))
