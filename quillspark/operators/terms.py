"""Terms over a corpus: frequencies, near twins, pinned renderings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import dims
from quillspark.functions.text import LETTERS, ends_word, fold, folded, starts_word, term_stem

MISSED = dims.REASONS["term"].format("([^']+)", "([^']+)")
#: A list that people keep; beyond this size every word of a text asks for its terms.
HELD_TERMS = 20_000


def frequencies(docs: DataFrame, text_col: str = "text", least: int = 6, min_hits: int = 5) -> DataFrame:
    """``(word, n)`` of folded words of ``least`` letters or more, in any script; partial counts first."""
    words = F.regexp_extract_all(fold(F.col(text_col)), F.lit(rf"{LETTERS}{{{least},}}"), 0)
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_hits)


def near_twins(words: DataFrame) -> DataFrame:
    """``(word_a, word_b, n_a, n_b)``: as long, one letter apart.

    Each word is listed under itself with one letter masked, for every letter;
    twins meet under exactly one mask, so nothing is compared or found twice.
    """
    masks = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.left("word", i - 1), F.lit("\x00"), F.substring(F.col("word"), i + 1, F.length("word"))))
    keyed = words.select("word", "n", F.explode(masks).alias("mask"))
    a, b = keyed.alias("a"), keyed.alias("b")
    return a.join(b, "mask").where(F.col("a.word") < F.col("b.word")).select(F.col("a.word").alias("word_a"), F.col("b.word").alias("word_b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))


def suggested(docs: DataFrame, done: DataFrame, most: int = 15, key: str = "rel", text_col: str = "text") -> DataFrame:
    """The ``most`` frequent near twins of the files that are done: ``docs (rel, text)``, ``done (rel)``."""
    twins = near_twins(frequencies(docs.join(done.select(key).distinct(), key, "left_semi"), text_col))
    return twins.orderBy(F.desc(F.col("n_a") + F.col("n_b")), "word_a", "word_b").limit(most)


def extended(glossary: DataFrame, more: DataFrame) -> DataFrame:
    """``glossary (src, dst)`` with the pairs of ``more``, which win; empty ones are left out."""
    named = lambda df, rank: df.select("src", "dst", F.lit(rank).alias("rank")).where("coalesce(src, '') <> '' and coalesce(dst, '') <> ''")
    return named(glossary, 0).union(named(more, 1)).groupBy("src").agg(F.max_by("dst", F.struct("rank", "dst")).alias("dst"))


def shown(glossary: DataFrame, found: DataFrame) -> DataFrame:
    """``(src, dst, n)``: the glossary with how often each term is missed."""
    return glossary.select("src", "dst").join(violations(glossary, found), "src")


def broken(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """``(doc_id, src, dst)`` of pinned terms that a pair doesn't render.

    ``pairs (doc_id, o, t)`` against ``glossary (src, dst)``, which may have
    ``phrases``, an array of exceptions: a term doesn't count within them.  A
    term counts where it starts a word of ``o``.  It is rendered if the stem of
    ``dst`` occurs in ``t``; if the term itself survives there as a word, it is
    not, unless ``dst`` begins with it or shares its stem.

    A text asks for the terms whose first letters begin one of its words, an
    equi-join; Spark broadcasts the glossary if it is small.  Of a glossary of
    ``HELD_TERMS`` at most, the first letters are a constant of the plan, so
    that a text only asks for what there is.
    """
    phrases = F.col("phrases") if "phrases" in glossary.columns else F.lit(None).cast("array<string>")
    s, d = fold(F.col("src")), fold(F.col("dst"))
    g = glossary.select("src", "dst", F.filter(F.transform(phrases, fold), lambda x: x != "").alias("phrases"), s.alias("s"), d.alias("d"), term_stem(F.col("src")).alias("s_stem"), term_stem(F.col("dst")).alias("d_stem"), F.regexp_extract(s, f"^{LETTERS}*", 0).alias("key")).where("s <> ''")
    sizes = sorted(r["n"] for r in g.select(F.length("key").alias("n")).distinct().collect())
    first = [r["key"] for r in g.select("key").distinct().limit(HELD_TERMS + 1).collect()]

    p = pairs.select("doc_id", fold(F.col("o")).alias("o"), fold(F.col("t")).alias("t"))
    words = F.array_distinct(F.regexp_extract_all("o", F.lit(f"{LETTERS}+"), 0))
    beginnings = lambda n: F.transform(F.filter(words, lambda w: F.length(w) >= n), lambda w: F.left(w, F.lit(n)))
    asked = [beginnings(n) for n in sizes if n]
    keys = F.array_distinct(F.concat(F.array(F.lit("")), *asked))
    if len(first) <= HELD_TERMS:
        keys = F.array_intersect(keys, F.lit(first) if first else F.array().cast("array<string>"))
    joined = p.select("*", F.explode(keys).alias("key")).join(g, "key")

    without = lambda text: F.aggregate(F.coalesce("phrases", F.array().cast("array<string>")), text, lambda rest, x: F.replace(rest, x, F.lit(" ")))
    o, t = without(F.col("o")), without(F.col("t"))
    related = F.regexp(F.col("d"), F.concat(F.lit("^"), starts_word(F.col("s")), ends_word(F.col("s")))) | (F.col("s_stem") == F.col("d_stem"))
    survives = t.contains(F.col("s")) & F.regexp(t, F.concat(starts_word(F.col("s")), ends_word(F.col("s"))))
    bad = ~F.col("t").contains(F.col("d_stem")) | (~related & survives)
    return joined.where(o.contains(F.col("s"))).where(F.regexp(o, starts_word(F.col("s")))).where(bad).select("doc_id", "src", "dst")


def violations(glossary: DataFrame, found: DataFrame) -> DataFrame:
    """``(src, n)`` of every term, with 0 where nothing is wrong."""
    counts = found.groupBy("src").agg(F.count("*").alias("n"))
    return glossary.select("src").distinct().join(counts, "src", "left").select("src", F.coalesce("n", F.lit(0)).alias("n"))


def conflicts(reasons: DataFrame) -> DataFrame:
    """``(term, expected, n_files, hits)`` of terms that fail in several files.

    ``reasons (file, seq, reason)``; ``expected`` is the first rendering seen.
    """
    terms = F.arrays_zip(*[F.regexp_extract_all("reason", F.lit(MISSED), g).alias(n) for g, n in ((1, "term"), (2, "dst"))])
    each = reasons.select("file", "seq", F.posexplode(terms).alias("at", "z")).select("file", "seq", "at", "z.term", "z.dst")
    found = each.groupBy("term").agg(F.min_by("dst", F.struct("file", "seq", "at")).alias("expected"), F.count_distinct("file").alias("n_files"), F.count("*").alias("hits"))
    return found.where("n_files > 1")


def extraction(replies: DataFrame) -> DataFrame:
    """``(doc_id, line_no, source, current, correct, reason)`` from ``(doc_id, reply)``.

    A line is a row if it has three fields or more, short terms that differ,
    and isn't NONE; bullets and numbering are dropped.
    """
    line = replies.select("doc_id", F.posexplode(F.split("reply", r"\r\n|\r|\n")).alias("line_no", "line"))
    line = line.withColumn("line", F.regexp_replace(F.trim("line"), r"^[-*0-9. ]+", "")).withColumn("f", F.transform(F.split("line", r"\|"), lambda x: F.trim(x)))
    field = lambda i: F.coalesce(F.try_element_at("f", F.lit(i)), F.lit(""))
    rows = line.where(F.size("f") >= 3).select("doc_id", "line_no", field(1).alias("source"), field(2).alias("current"), field(3).alias("correct"), field(4).alias("reason"))
    return rows.where("source <> '' and correct <> '' and length(source) <= 40 and length(correct) <= 40 and lower(source) <> lower(correct)")


# ---- evidence for one pair, in plain Python ----


def wrong_rendering(src: str, dst: str, orig: str, trad: str, glossary: dict[str, str]) -> str:
    """What was written in place of ``dst``, as a note; empty if it can't be told.

    Every word of ``trad`` within two letters of ``dst`` is a suspect.  One that
    is the rendering of another term, which ``orig`` lacks, comes first, by the
    order of the glossary; then words that no term of ``orig`` explains, by the
    alphabet.
    """
    from quillspark.operators.client import distance

    words = {side: set(re.findall(r"\w+", folded(text))) for side, text in (("o", orig), ("t", trad))}
    texts = {"o": folded(orig), "t": folded(trad)}
    stands = lambda term, side: folded(term) in words[side] or bool(re.search(rf"\b{re.escape(folded(term))}\b", texts[side]))
    want = folded(dst)
    entries = [(k, s, d, stands(s, "o")) for k, (s, d) in enumerate(glossary.items())]
    explained = {want, *(folded(d) for _, _, d, there in entries if there)}
    close = lambda word: word != want and distance(word, want) <= dims.TWIN_DISTANCE
    suspects = [(0, k, "twin", (d, s, src)) for k, s, d, there in entries if not there and folded(s) != folded(src) and close(folded(d)) and stands(d, "t")]
    suspects += [(1, w, "near", (w,)) for w in words["t"] - explained if close(w)]
    if not suspects:
        return ""
    *_, kind, told = min(suspects, key=lambda x: (x[0], x[1]) if x[0] == 0 else (1, x[1]))
    return dims.REASONS[kind].format(*told)
