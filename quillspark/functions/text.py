"""Text functions as Column expressions: they stay inside generated code."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import dims

ELLIPSIS = dims.ELLIPSIS
SENTENCE_END = r"(?<=[.;:!?])\s+"
TAG = r"<[^>]*>"
LETTERS = r"[\p{L}\p{N}_]"  # what words are made of, in any script


@lru_cache(1)
def unmarked() -> tuple[str, str]:
    """Lower-case letters with marks and their bare letters; marks by themselves have none.

    By Unicode's canonical decomposition, over the basic plane; what decomposes
    into several letters stays.
    """
    bare, marks = {}, []
    for c in map(chr, range(0x80, 0x10000)):
        if unicodedata.combining(c):
            marks.append(c)
        elif c.lower() == c and len(base := "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))) == 1 and base != c:
            bare[c] = base
    return "".join([*bare, *marks]), "".join(bare.values())


def fold(text: Column) -> Column:
    """Lower case without the marks of letters, in any script."""
    return F.translate(F.lower(text), *unmarked())


def folded(text: str) -> str:
    """:func:`fold` of a plain string."""
    letters, bare = unmarked()
    return text.lower().translate(str.maketrans(letters[: len(bare)], bare, letters[len(bare) :]))


def starts_word(term: Column) -> Column:
    """Pattern for a folded term where a word begins, whatever signs it holds."""
    return F.concat(F.when(term.rlike(f"^{LETTERS}"), f"(?<!{LETTERS})").otherwise(f"(?<={LETTERS})"), quoted(term))


def ends_word(term: Column) -> Column:
    """Pattern for what follows a folded term where a word ends."""
    return F.when(term.rlike(f"{LETTERS}$"), f"(?!{LETTERS})").otherwise(f"(?={LETTERS})")


def quoted(term: Column) -> Column:
    """Pattern for a term, sign by sign."""
    return F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def term_stem(term: Column) -> Column:
    """Folded term without its inflection: 4 letters off beyond 7, 1 off from 5 on."""
    f = fold(term)
    n = F.length(f)
    return F.when(n > 7, F.left(f, n - 4)).when(n >= 5, F.left(f, n - 1)).otherwise(f)


def ellipses(text: Column) -> Column:
    """How many ellipses, spelled as one sign, close dots or spaced dots."""
    return F.regexp_count(text, F.lit(ELLIPSIS))


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the edges."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def sentences(text: Column) -> Column:
    """Sentences of plain text; empty ones are left out."""
    return F.filter(F.split(collapsed(text), SENTENCE_END), lambda s: s != "")


def prose_only(text: Column) -> Column:
    """Without quoted inline elements (and what they hold), then without tags."""
    names = "|".join(dims.QUOTED_TAGS)
    return F.regexp_replace(F.regexp_replace(text, rf"(?is)<({names})\b[^>]*>.*?</\1\s*>", " "), TAG, " ")


def whole_word(word: str) -> str:
    """Pattern for the word between non-word characters, for folded text."""
    return rf"(?U)(?<!\w)\Q{word}\E(?!\w)"


def slug(title: Column) -> Column:
    """Lower-case words joined by hyphens; ``book`` if nothing is left."""
    made = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(made, F.lit("")), F.lit("book"))


def lang_code(name: Column) -> Column:
    """Code of a language name; two letters are a code, else the first two, else ``xx``."""
    key = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    known = F.create_map(*[F.lit(x) for pair in dims.LANG_CODES.items() for x in pair])
    return F.coalesce(known[key], F.nullif(F.left(key, F.lit(2)), F.lit("")), F.lit("xx"))


def category(reason: Column) -> Column:
    """``llm-error`` for a failing endpoint, else ``quality``."""
    return F.when(F.lower(F.coalesce(reason, F.lit(""))).rlike("llm|http|unreachable| 507"), "llm-error").otherwise("quality")


def sample(text: Column, limit: int) -> Column:
    """Head, middle and tail thirds of what is longer than ``limit``."""
    third, gap = limit // 3, F.lit("\n[…]\n")
    middle = F.substring(text, F.floor((F.length(text) - third) / 2).cast("int") + 1, F.lit(third))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(third)), gap, middle, gap, F.right(text, F.lit(third))))


def has_issue(score: Column, comment: Column) -> Column:
    """A judge below 10 that names something and doesn't call it faithful."""
    note = F.lower(F.trim(F.coalesce(comment, F.lit(""))))
    return F.coalesce((score < 10) & (note != "") & ~note.startswith("faithful") & ~note.startswith("fedele"), F.lit(False))


def judge_score(report: Column) -> Column:
    """The first ``n/10`` of a report, at most 10; null without one."""
    found = F.regexp_extract(report, r"(\d{1,2})\s*/\s*10", 1)
    return F.when(found != "", F.least(found.cast("int"), F.lit(10)))


def judge_comment(report: Column) -> Column:
    """What follows the score on its line, or the first line without a score."""
    after = F.regexp_extract(report, r"\d{1,2}\s*/\s*10[ \|/\-—:]*([^\r\n]*)", 1)
    first = F.regexp_extract(F.trim(report), r"^([^\r\n]*)", 1)
    return F.when(judge_score(report).isNotNull(), F.trim(after)).otherwise(first)


def leftover_ok(new: Column, old: Column, gone: Column) -> Column:
    """A rewritten sentence: no markup, the word gone, half to twice as long."""
    ratio = F.length(new) / F.greatest(F.length(old), F.lit(1))
    return (new != "") & ~new.contains("<") & ~new.contains(">") & gone & ratio.between(0.5, 2.0)


def encoded(text: Column) -> Column:
    """Model text as markup: the three special characters and the hard space."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), (" ", "&#160;"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def rewrite_lang(html: Column, code: str) -> Column:
    """Every language attribute set to ``code``; ``<html>`` gets one if it has none."""
    text = F.regexp_replace(html, r"""(xml:lang|lang)\s*=\s*("[^"]*"|'[^']*')""", f'$1="{code}"')
    tag = F.regexp_extract(text, r"(?i)<html\b[^>]*>", 0)
    filled = F.concat(F.regexp_replace(tag, r"\s*>$", ""), F.lit(f' lang="{code}" xml:lang="{code}">'))
    at = F.instr(text, tag)
    inserted = F.concat(F.left(text, at - 1), filled, F.substring(text, at + F.length(tag), F.length(text)))
    return F.when((tag != "") & ~tag.contains("lang="), inserted).otherwise(text)


def match_line_ending(text: Column, reference: Column) -> Column:
    """CRLF throughout if the reference has any, else LF."""
    lf = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(reference.contains("\r\n"), F.replace(lf, F.lit("\n"), F.lit("\r\n"))).otherwise(lf)


def any_of(names: Sequence[str]) -> str:
    """A regex alternative of literal names."""
    return "|".join(names)
