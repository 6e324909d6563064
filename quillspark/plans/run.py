"""The run to a fixpoint: translate what is missing, verify, repair, judge.

Each pass writes its outcomes before it reads them, so a model is never asked
twice for the same answer, and a lost executor costs one pass at most.  The
log is the union of what the passes wrote; nothing is written twice.  Only
counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import dims
from quillspark.functions.text import has_issue, match_line_ending, rewrite_lang
from quillspark.operators import client, diff, leftovers, outcomes, segment, splice, verify

PASS_MARK = 7
Write = Callable[[DataFrame, str], DataFrame]


def rebuilt(docs: DataFrame, log: DataFrame, cfg: dict) -> DataFrame:
    """``(rel, orig, trad)`` from the latest good outcomes, in the target language and the original's line endings."""
    units = segment.units(docs, tuple(cfg["code_class_hints"]), "rel", "orig")
    good = outcomes.latest(log).where("status = 'ok'").select(F.col("rel").alias("doc_id"), "idx", F.col("text").alias("inner"))
    whole = splice.spliced(docs, units, good, "rel", "orig").select(F.col("doc_id").alias("rel"), F.col("html").alias("trad"))
    trad = match_line_ending(rewrite_lang(F.col("trad"), cfg["dest_code"]), F.col("orig"))
    return docs.select("rel", "orig").join(whole, "rel").select("rel", "orig", trad.alias("trad"))


def one_pass(docs: DataFrame, log: DataFrame | None, cfg: dict, chat: client.Chat, seq: int) -> DataFrame:
    """Outcomes of one pass over units without a valid good outcome."""
    hashed = docs.select("rel", "orig", outcomes.source_hash(F.col("orig")).alias("orig_hash"))
    kind = "array<struct<idx:int,attempts:bigint,reason:string,inner:string>>"
    if log is None:
        asked = hashed.withColumn("history", F.lit(None).cast(kind))
    else:
        past = outcomes.valid_for(log, docs).join(outcomes.attempts(log), ["rel", "idx"])
        entry = F.struct("idx", F.col("attempts").cast("long").alias("attempts"), "reason", F.when(F.col("status") == "ok", F.col("text")).alias("inner"))
        asked = hashed.join(past.groupBy("rel").agg(F.collect_list(entry).cast(kind).alias("history")), "rel", "left")
    found = client.translate_documents(asked, cfg, chat)
    return found.join(hashed.select("rel", "orig_hash"), "rel").select("rel", "idx", "orig_hash", "status", "reason", F.col("inner").alias("text"), F.lit(seq).cast("long").alias("seq"))


def blamed(pairs: DataFrame, cfg: dict) -> DataFrame:
    """``(rel, idx, reason)``: units of ``pairs (rel, orig, trad)`` that a defect falls into."""
    named = pairs.select(F.col("rel").alias("doc_id"), "orig", "trad")
    units = segment.units(named, tuple(cfg["code_class_hints"]), "doc_id", "trad")
    return diff.blamed_units(diff.defects(named, cfg), units).withColumnRenamed("doc_id", "rel")


def run(docs: DataFrame, cfg: dict, chat: client.Chat, write: Write, passes: int = 4) -> tuple[DataFrame, DataFrame]:
    """``(log, pairs)`` after up to ``passes`` passes over ``docs (rel, orig)``.

    ``write(df, name)`` stores a table and returns it as read back.  A unit that
    verification blames is tried again.  It ends when no unit is open and every
    file verifies, or when the number of failing files and open units no longer
    changes; :func:`saved_failing` names the files.
    """
    cfg, parts, before, pairs = dims.DEFAULTS | cfg, [], None, None
    hashed = docs.select("rel", outcomes.source_hash(F.col("orig")).alias("orig_hash"))
    whole = lambda: reduce(DataFrame.unionByName, parts)
    for seq in range(passes):
        parts.append(write(one_pass(docs, whole() if parts else None, cfg, chat, 2 * seq), f"pass-{seq}"))
        pairs = write(rebuilt(docs, whole(), cfg), f"pairs-{seq}")
        bad = blamed(pairs, cfg).join(hashed, "rel").select("rel", "idx", "orig_hash", F.lit("fail").alias("status"), "reason", F.lit(None).cast("string").alias("text"), F.lit(2 * seq + 1).cast("long").alias("seq"))
        parts.append(write(bad, f"verified-{seq}"))
        state = saved_failing(pairs, cfg).count(), outcomes.latest(whole()).where("status <> 'ok'").count()
        if not any(state) or state == before:
            break
        before = state
    return whole(), pairs


def saved_failing(pairs: DataFrame, cfg: dict) -> DataFrame:
    """``(rel, score, reasons)`` of saved files that no longer verify."""
    cfg = dims.DEFAULTS | cfg
    named = pairs.select(F.col("rel").alias("doc_id"), "orig", "trad")
    checked = verify.full(named, cfg, cfg["dest_code"], tuple(cfg["code_class_hints"]))
    return checked.where("not passed").select(F.col("doc_id").alias("rel"), "score", "reasons")


def _candidates(changed: DataFrame, scores: DataFrame, cfg: dict, judge: client.Chat, write: Write, name: str) -> DataFrame:
    """``(rel, orig, current, polished, verified, old_score, new_score, comment, out)`` of rewritten files."""
    new = write(changed.where("changed > 0"), f"{name}-rewritten")
    as_pairs = new.select("rel", "orig", F.col("rewritten").alias("trad"))
    failing = saved_failing(as_pairs, cfg).select("rel", F.lit(False).alias("fine"))
    fine = as_pairs.join(failing, "rel", "left_anti")
    judged = client.judge_pairs(fine, cfg, judge).select("rel", F.col("score").alias("new_score"), F.col("comment").alias("new_comment"))
    both = new.join(scores.select("rel", F.col("score").alias("old_score")), "rel").join(judged, "rel", "left").join(failing, "rel", "left")
    return write(both.select("rel", "orig", "current", F.col("rewritten").alias("polished"), F.coalesce("fine", F.lit(True)).alias("verified"), "old_score", "new_score", "new_comment"), f"{name}-judged")


def _taken(pairs: DataFrame, scores: DataFrame, candidates: DataFrame, kept: Callable[[DataFrame], DataFrame], write: Write, name: str) -> tuple[DataFrame, DataFrame]:
    """Pairs and scores with the candidates that ``kept`` takes."""
    better = kept(candidates).where("taken").join(candidates.select("rel", "new_score", "new_comment"), "rel").select("rel", "text", "new_score", "new_comment")
    better = write(better, f"{name}-taken")
    left = pairs.join(better, "rel", "left").select("rel", "orig", F.coalesce("text", "trad").alias("trad"))
    told = scores.join(better, "rel", "left").select("rel", F.coalesce("new_score", "score").alias("score"), F.coalesce("new_comment", "comment").alias("comment"))
    return write(left, f"{name}-pairs"), write(told, f"{name}-scores")


def quality_gate(pairs: DataFrame, cfg: dict, chat: client.Chat, judge: client.Chat, write: Write, mark: int = PASS_MARK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(pairs, verdicts, stubborn)``: what may be packed, after judging and repairs.

    Every file is judged.  One with a named issue is polished by the judge's
    note, and source words left over are rewritten; each is kept only if it
    verifies and the judge agrees (better for a polish, no worse for words).
    What is still below ``mark`` is translated afresh once and judged again.

    ``verdicts (rel, score, comment, blocked)``: a file still below the mark is
    blocked.  If the judge is out, nothing is: files pass unjudged, with a null
    score.  ``stubborn (rel, word)`` are source words no rewrite could replace.
    """
    cfg = dims.DEFAULTS | cfg
    pairs = pairs.select("rel", "orig", "trad")
    scores = write(client.judge_pairs(pairs, cfg, judge).select("rel", "score", "comment"), "gate-scores")
    verdicts = lambda s: s.select("rel", "score", "comment", F.coalesce(F.col("score") < mark, F.lit(False)).alias("blocked"))
    none = pairs.sparkSession.createDataFrame([], "rel string, word string")
    out = scores.where("score is null").limit(1).count() > 0
    if out:
        return pairs, verdicts(scores.withColumn("score", F.lit(None).cast("int"))), none

    flagged = pairs.join(scores.where(has_issue(F.col("score"), F.col("comment"))).select("rel", "comment"), "rel")
    polish = lambda o, t, note: (*client.polish(o, t, note, cfg, chat), [])
    done = _candidates(client.rewritten(flagged, polish, "comment"), scores, cfg, judge, write, "polish")
    pairs, scores = _taken(pairs, scores, done, kept_polish, write, "polish")

    listed = leftovers.word_list(cfg["source_lang"], tuple(cfg.get("leftover_words") or ()))
    common = F.array_intersect(leftovers.hits(F.col("trad"), listed), leftovers.hits(F.col("orig"), listed))
    wordy = pairs.withColumn("words", F.array_join(common, "\n")).where("words <> ''")

    def without(o: str, t: str, words: str) -> tuple[str, int, list[str]]:
        text, fixed, left = client.fix_leftovers(o, t, set(words.split("\n")), cfg, chat)
        return text, fixed, sorted({w for w, _ in left})

    changed = write(client.rewritten(wordy, without, "words"), "leftovers-tried")
    done = _candidates(changed, scores, cfg, judge, write, "leftovers")
    pairs, scores = _taken(pairs, scores, done, kept_leftovers, write, "leftovers")
    stubborn = write(changed.select("rel", F.explode("left").alias("word")), "stubborn")

    low = write(pairs.join(scores.where(F.col("score") < mark).select("rel"), "rel", "left_semi"), "gate-low")
    if not low.isEmpty():
        _, again = run(low.select("rel", "orig"), cfg, chat, lambda df, name: write(df, f"again-{name}"))
        judged = write(client.judge_pairs(again, cfg, judge), "again-scores")
        pairs = write(pairs.join(again.select("rel", F.col("trad").alias("new")), "rel", "left").select("rel", "orig", F.coalesce("new", "trad").alias("trad")), "gate-pairs")
        # a judge that is out by now says nothing against a file
        told = judged.select("rel", F.col("score").alias("now"), F.col("comment").alias("said"), F.lit(True).alias("again"))
        scores = write(scores.join(told, "rel", "left").select("rel", F.when(F.col("again"), F.col("now")).otherwise(F.col("score")).alias("score"), F.when(F.col("again"), F.col("said")).otherwise(F.col("comment")).alias("comment")), "gate-final")
    return pairs, verdicts(scores), stubborn


def gate(scores: DataFrame, mark: int = PASS_MARK) -> DataFrame:
    """``(rel, action)`` for judged files ``(rel, score, comment)``.

    Without a score a file passes unjudged; below the mark it is done afresh; a
    named issue below ten earns a polish.
    """
    s, c = F.col("score"), F.col("comment")
    action = F.when(s.isNull(), "unjudged").when(s < mark, "retranslate").when(has_issue(s, c), "polish").otherwise("keep")
    return scores.select("rel", action.alias("action"))


def kept_polish(candidates: DataFrame) -> DataFrame:
    """Of ``(rel, current, polished, verified, old_score, new_score)`` the text that stays.

    A polished text must verify and score higher.
    """
    better = F.col("verified") & (F.col("new_score") > F.col("old_score"))
    return candidates.select("rel", F.when(better, F.col("polished")).otherwise(F.col("current")).alias("text"), F.coalesce(better, F.lit(False)).alias("taken"))


def kept_leftovers(candidates: DataFrame) -> DataFrame:
    """As :func:`kept_polish`, but an equal score will do."""
    fine = F.col("verified") & (F.col("new_score") >= F.col("old_score"))
    return candidates.select("rel", F.when(fine, F.col("polished")).otherwise(F.col("current")).alias("text"), F.coalesce(fine, F.lit(False)).alias("taken"))
