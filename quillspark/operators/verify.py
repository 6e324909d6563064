"""Checks of a pair of documents as columns of one row, without a shuffle."""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed by the check's meaning: bare ``<p>`` isn't counted, ``<p `` is.
KEY_TAGS = r"<p |<div |<em>|</em>|<strong>|</strong>|<a |<h[1-6] "
PAGE_BREAK = 'epub:type="pagebreak"'
CHECKS = ("tags", "code", "pagebreak", "ids", "hrefs", "lang", "length")


def parse_error(text: str | None) -> str | None:
    """What keeps a document from being well-formed XML; None if nothing does."""
    try:
        expat.ParserCreate().Parse((text or "").encode("utf-8", "replace"), True)
    except expat.ExpatError as e:
        return str(e)
    return None


@F.pandas_udf(StringType())
def parse_errors(texts: pd.Series) -> pd.Series:
    return texts.map(parse_error)


def counts(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def values_of(text: Column, attribute: str) -> Column:
    """Sorted double-quoted values of an attribute, repeats included."""
    return F.array_sort(F.regexp_extract_all(text, F.lit(rf'\s{attribute}="([^"]*)"'), 1))


def html_tag(text: Column) -> Column:
    return F.regexp_extract(text, r"<html\b[^>]*>", 0)


def checks(pairs: DataFrame, code: str = "it", hints: tuple[str, ...] = (), page_break: str = PAGE_BREAK, least: float = 0.5) -> DataFrame:
    """``pairs (doc_id, orig, trad)`` with one boolean column per check."""
    return pairs.select("doc_id", *flags(code, hints, page_break, least))


def flags(code: str = "it", hints: tuple[str, ...] = (), page_break: str = PAGE_BREAK, least: float = 0.5) -> list[Column]:
    """Each check of a row's ``orig`` and ``trad``, named."""
    o, t = F.col("orig"), F.col("trad")
    hinted = "|".join(f'class="{re.escape(h)}"' for h in hints)
    tag = html_tag(t)
    return [
        (counts(o, KEY_TAGS) == counts(t, KEY_TAGS)).alias("tags"),
        (counts(o, hinted) == counts(t, hinted) if hints else F.lit(True)).alias("code"),
        (counts(o, page_break) == counts(t, page_break)).alias("pagebreak"),
        (values_of(o, "id") == values_of(t, "id")).alias("ids"),
        (values_of(o, "href") == values_of(t, "href")).alias("hrefs"),
        (tag.contains(f'lang="{code}"') | tag.contains(f"lang='{code}'")).alias("lang"),
        (F.length(t) >= least * F.length(o)).alias("length"),
    ]


def scored(checked: DataFrame, names: tuple[str, ...] = CHECKS) -> DataFrame:
    """Adds ``passed``, ``score`` (per cent, half to even) and failing ``reasons``."""
    flags = F.array(*[F.col(n) for n in names])
    share = F.size(F.filter(flags, lambda f: f)) * 100 / F.lit(len(names))
    reasons = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in names]))
    return checked.withColumns({"passed": F.forall(flags, lambda f: f), "score": F.bround(share).cast("int"), "reasons": F.array_join(reasons, ";")})


def health(scored_pairs: DataFrame, by: str) -> DataFrame:
    """Documents, passing ones and average score of each group."""
    return scored_pairs.groupBy(by).agg(F.count("*").alias("checked"), F.count_if("passed").alias("n_passed"), F.sum("score").alias("score_sum"))


def fragment_error(text: str) -> str | None:
    """What keeps a fragment from being well-formed; entities needn't be known."""
    error = parse_error(f"<r>{text}</r>")
    return None if error and "undefined entity" in error else error


def full(pairs: DataFrame, cfg: dict | None = None, code: str = "it", hints: tuple[str, ...] = ()) -> DataFrame:
    """All nine checks: those of :func:`checks`, well-formedness and structure.

    ``struct_reason`` holds the first three defects of a pair.
    """
    from quillspark.operators.diff import first_defects

    read = first_defects(pairs.select("doc_id", "orig", "trad"), cfg)
    all_checks = read.select("doc_id", parse_errors("trad").isNull().alias("xhtml"), *flags(code, hints), F.col("struct_reason").isNull().alias("struct"), "struct_reason")
    return scored(all_checks, ("xhtml", *CHECKS, "struct"))
