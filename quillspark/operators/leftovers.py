"""Function words of the source language that survive in the other version."""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import dims
from quillspark.functions.text import prose_only, sentences
from quillspark.operators.segment import lex

END = re.compile(r"(?<=[.;:!?])\s+")


def word_list(language: str = "english", extra: tuple[str, ...] = ()) -> list[str]:
    """The words of a language and further ones, lower case, each once."""
    return sorted(set(dims.FUNCTION_WORDS.get(language.strip().lower(), ())) | {w.strip().lower() for w in extra if w and w.strip()})


def any_of(words: list[str]) -> str:
    """Pattern for any of the words, longest first, as a whole word."""
    return r"(?U)(?<!\w)(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + r")(?!\w)"


def hits(text: Column, words: list[str]) -> Column:
    """Every occurrence of the words outside quoted elements, in order."""
    return F.regexp_extract_all(F.lower(prose_only(text)), F.lit(any_of(words)), 0) if words else F.array().cast("array<string>")


def find(pairs: DataFrame, language: str = "english", extra: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, word, n)`` left in ``trad`` that ``orig`` also has.

    Both texts lie in one row, so that nothing is shuffled; a word's count is
    taken from the row's own list.
    """
    words = word_list(language, extra)
    both = pairs.select("doc_id", hits(F.col("trad"), words).alias("left"), F.array_distinct(hits(F.col("orig"), words)).alias("source"))
    found = both.select("doc_id", "left", F.explode(F.array_intersect("left", "source")).alias("word"))
    return found.select("doc_id", "word", F.size(F.filter("left", lambda w: w == F.col("word"))).cast("long").alias("n"))


def sentence_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(sentences(F.col(text_col))).alias("sent_no", "sentence"))


def occurrences(text: str, words: set[str]) -> list[tuple[int, int, str]]:
    """``(start, end, word)``: each sentence within a text node that has a word, once."""
    first: dict[tuple[int, int], str] = {}
    for tok in lex(text):
        if tok.kind != "text":
            continue
        cuts = [0, *(m.end() for m in END.finditer(tok.raw)), len(tok.raw)]
        for word in sorted(words):
            for m in re.finditer(rf"(?<!\w){re.escape(word)}(?!\w)", tok.raw, re.I):
                a = max(c for c in cuts if c <= m.start())
                b = min((c for c in cuts if c >= m.end() and c > a), default=len(tok.raw))
                first.setdefault((tok.start + a, tok.start + b), word)
    return sorted((a, b, w) for (a, b), w in first.items())


def plain(text: str) -> str:
    return entities.unescape("".join(t.raw for t in lex(text) if t.kind == "text"))


def has_any(block: Column, words: list[str]) -> Column:
    """Whether a block's plain prose still has one of the words."""
    return F.regexp_like(F.lower(prose_only(block)), F.lit(any_of(words))) if words else F.lit(False)


def sentence_spans(pairs: DataFrame, language: str = "english", extra: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, start, end, word, sentence)`` to rewrite: sentences of ``trad`` with leftovers."""
    listed = word_list(language, extra)
    words = F.array_intersect(hits(F.col("trad"), listed), hits(F.col("orig"), listed))

    def rows(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for doc, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b, word in occurrences(text or "", set(found)):
                    for col, v in zip(cols, (doc, a, b, word, text[a:b]), strict=True):
                        col.append(v)
            kinds = [batch.column(0).type, pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "end", "word", "sentence"])

    asked = pairs.select("doc_id", "trad", words.alias("words")).where(F.size("words") > 0)
    return asked.mapInArrow(rows, f"doc_id {pairs.schema['doc_id'].dataType.simpleString()}, start int, end int, word string, sentence string")
