"""Structural comparison of a pair.

Prologue, attributes and content are columns or joins on positions.  The
alignment of two token sequences and the moves within it have no relational
form; they are one Arrow kernel per pair around ``difflib``.
"""

from __future__ import annotations

import difflib
import html as entities
import re
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import dims
from quillspark.functions.text import TAG, ellipses
from quillspark.functions.text import folded as fold
from quillspark.operators import lexer
from quillspark.operators.segment import BLOCKS, Tok, lex
from quillspark.operators.verify import parse_error

PROSE = frozenset(dims.PROSE_BLOCKS)
ELLIPSIS = re.compile(dims.ELLIPSIS)
LANG_VALUE = r"""\s*(?:xml:)?lang\s*=\s*(?:"[^"]*"|'[^']*')"""
SHOWN = 6


# ---- native parts ----


def prologue_differs(orig: Column, trad: Column) -> Column:
    """Texts through ``<html>`` differ in more than language attributes."""
    head = r"(?s)^.*?<html\b[^>]*>"
    a, b = (F.regexp_extract(x, head, 0) for x in (orig, trad))
    bare = lambda x: F.regexp_replace(x, LANG_VALUE, "")
    return (a != "") & (b != "") & (bare(a) != bare(b))


def prose_length(block: Column) -> Column:
    return F.length(F.trim(F.regexp_replace(block, TAG, "")))


def blocks(html: Column, name: str) -> Column:
    """Plain text of the innermost ``<name>`` elements in order."""
    found = F.regexp_extract_all(html, F.lit(rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>"), 1)
    return F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, TAG, ""), r"\s+", " ")))


def content_defects(pairs: DataFrame, name: str, least: int = 80, ratio: float = 0.7) -> DataFrame:
    """``(doc_id, block_no, kind, o_len, t_len)``: short text, else added ellipsis.

    Blocks are paired by position, where both sides have as many, within their
    row: nothing is shuffled.
    """
    both = pairs.select("doc_id", blocks(F.col("orig"), name).alias("o"), blocks(F.col("trad"), name).alias("t")).where(F.size("o") == F.size("t"))
    each = both.select("doc_id", F.posexplode(F.arrays_zip("o", "t")).alias("block_no", "z")).select("doc_id", "block_no", "z.o", "z.t")
    n, m = F.length("o"), F.length("t")
    kind = F.when((n >= least) & (m < ratio * n), "short_text").when(ellipses(F.col("t")) > ellipses(F.col("o")), "ellipsis")
    return each.select("doc_id", "block_no", kind.alias("kind"), n.alias("o_len"), m.alias("t_len")).where("kind is not null")


def attribute_defects(pairs: DataFrame) -> DataFrame:
    """``(doc_id, pos, name)`` of start tags whose attributes changed.

    For pairs whose tag sequences are the same one to one; others are left to
    the alignment.
    """

    def tags(col: str) -> Column:
        return F.filter(lexer.raw_tokens(F.col(col)), lambda r: F.length(lexer.name_of(r)) > 0)

    shape = lambda tags: F.transform(tags, lambda r: F.concat(F.when(r.startswith("</"), "/").otherwise(""), lexer.name_of(r)))
    cut = pairs.select("doc_id", tags("orig").alias("o"), tags("trad").alias("t")).where(shape(F.col("o")) == shape(F.col("t")))
    each = cut.select("doc_id", F.posexplode(F.arrays_zip("o", "t")).alias("pos", "z")).select("doc_id", "pos", "z.o", "z.t").where("o <> t")
    differ = lexer.signature(lexer.attributes(F.col("o"))) != lexer.signature(lexer.attributes(F.col("t")))
    return each.where(~F.col("o").startswith("</")).where(differ).select("doc_id", "pos", lexer.name_of(F.col("o")).alias("name"))


# ---- kernel ----


@dataclass
class Defect:
    kind: str
    detail: str
    orig: tuple[int, int] | None = None
    trad: tuple[int, int] | None = None
    block_orig: tuple[int, int] | None = None
    block_trad: tuple[int, int] | None = None


def stem(term: str) -> str:
    f = fold(term)
    return f[:-4] if len(f) > 7 else f[:-1] if len(f) > 4 else f


def broken_terms(orig: str, trad: str, glossary: dict[str, str], exceptions: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """Pinned terms that ``orig`` has and ``trad`` doesn't render as required.

    A term counts where it starts a word, outside its exception phrases.  It is
    rendered if the stem of its rendering occurs.  If the term itself survives
    as a word, it is not, unless the rendering keeps it or shares its stem.
    """
    out, o_all, t_all = [], fold(orig), fold(trad)
    for src, dst in glossary.items():
        o, t, word = o_all, t_all, re.escape(fold(src))
        for phrase in filter(None, (exceptions or {}).get(src, ())):
            o, t = o.replace(fold(phrase), " "), t.replace(fold(phrase), " ")
        if not re.search(rf"\b{word}", o):
            continue
        related = re.match(rf"{word}\b", fold(dst)) or stem(src) == stem(dst)
        if stem(dst) not in t_all or (not related and re.search(rf"\b{word}\b", t)):
            out.append((src, dst))
    return out


class Side:
    """One document of a pair: tokens, and where blocks begin and end."""

    def __init__(self, text: str):
        self.text, self.toks = text, lex(text)

    def _elements(self, names: frozenset[str]) -> dict[int, int]:
        """Closing token of each element of these names; any closing tag ends the last."""
        out, inside = {}, []
        for i, t in enumerate(self.toks):
            if t.name in names:
                if t.kind == "open":
                    inside.append(i)
                elif t.kind == "close" and inside:
                    out[inside.pop()] = i
        return out

    @cached_property
    def prose(self) -> dict[int, int]:
        return self._elements(PROSE)

    @cached_property
    def context(self) -> list[tuple[int, int] | None]:
        """Span of the innermost block around each token; a block's tags are its own."""
        ends, inside, out = self._elements(BLOCKS), [], []
        for i, t in enumerate(self.toks):
            if i in ends:
                inside.append((t.start, self.toks[ends[i]].end))
            out.append(inside[-1] if inside else None)
            if t.kind == "close" and t.name in BLOCKS and inside:
                inside.pop()
        return out

    def block_at(self, i: int) -> tuple[int, int] | None:
        return self.context[min(i, len(self.toks) - 1)] if self.toks else None

    def span(self, a: int, b: int) -> tuple[int, int] | None:
        return (self.toks[a].start, self.toks[b - 1].end) if a < b else None

    def prose_text(self, i: int) -> str:
        return "".join(t.raw for t in self.toks[i : self.prose[i] + 1] if t.kind == "text")

    def names(self, a: int, b: int) -> str:
        return ",".join(sorted({t.name for t in self.toks[a:b] if t.tag}))

    def visible(self, span: tuple[int, int]) -> int:
        return len(re.sub(TAG, "", self.text[span[0] : span[1]]).strip())


def _shape(t: Tok) -> tuple:
    return (t.kind, t.name) if t.tag else (t.kind,)


def _signed(t: Tok) -> tuple:
    return tuple(sorted(a for a in t.attrs if a[0] not in dims.LANG_ATTRS))


def _identity(t: Tok) -> tuple:
    return (t.kind, t.name, _signed(t) if t.kind != "close" else ())


def moves(o: Side, t: Side, steps: list, least: int, ratio: float) -> set[int]:
    """Steps of the alignment that only move inline tags within a block."""
    by_block: dict[tuple, list[int]] = {}
    for k, (what, a, _, b, _) in enumerate(steps):
        where = (o.block_at(a), t.block_at(b))
        if what != "equal" and None not in where:
            by_block.setdefault(where, []).append(k)
    out: set[int] = set()
    for (left, right), ks in by_block.items():
        gone = [_identity(x) for k in ks for x in o.toks[steps[k][1] : steps[k][2]] if x.tag]
        come = [_identity(x) for k in ks for x in t.toks[steps[k][3] : steps[k][4]] if x.tag]
        same = gone and sorted(gone) == sorted(come) and not any(name in BLOCKS for _, name, _ in gone)
        n = o.visible(left) if same else 0
        if same and (n < least or t.visible(right) >= ratio * n):
            out.update(ks)
    return out


def _listed(attrs: list[tuple[str, str]]) -> str:
    items = sorted(attrs)
    text = ", ".join(f"{n}={v!r}" if v else n for n, v in items[:SHOWN])
    return f"[{text}{f', +{len(items) - SHOWN} more' if len(items) > SHOWN else ''}]"


def _prologue(side: Side) -> str | None:
    end = next((x.end for x in side.toks if x.kind == "open" and x.name == "html"), None)
    return None if end is None else side.text[:end]


def _content(o: Side, t: Side, i: int, j: int, cfg: dict) -> list[Defect]:
    """Lost or untranslated prose of one aligned block."""
    name, left, right = o.toks[i].name, o.prose_text(i), t.prose_text(j)
    spans = ((o.toks[i].start, o.toks[o.prose[i]].end), (t.toks[j].start, t.toks[t.prose[j]].end))
    at = (*spans, *spans)
    n, m = (len(" ".join(entities.unescape(x).split())) for x in (left, right))
    if n >= cfg["block_text_min"] and m < cfg["block_text_ratio"] * n:
        return [Defect("short_text", f"text abbreviated in <{name}>: {m} of {n} chars ({round(100 * m / max(n, 1))}%)", *at)]
    out = []
    a, b = (len(ELLIPSIS.findall(entities.unescape(x))) for x in (left, right))
    if b > a:
        out.append(Defect("ellipsis", f"ellipsis added in <{name}>: {b} vs {a} — text likely omitted", *at))
    for src, dst in broken_terms(left, right, cfg.get("glossary") or {}, cfg.get("glossary_exceptions")):
        out.append(Defect("glossary", f"term '{src}' not rendered as '{dst}' in <{name}>", *at))
    return out


def analyze(orig: str, trad: str, cfg: dict | None = None, well_formed: bool = False) -> list[Defect]:
    """Defects of ``trad`` against ``orig``, in order of the alignment."""
    cfg = dims.DEFAULTS | (cfg or {})
    hints = frozenset(cfg["code_class_hints"])
    o, t = Side(orig), Side(trad)
    out: list[Defect] = []
    a, b = _prologue(o), _prologue(t)
    if a is not None and b is not None and re.sub(LANG_VALUE, "", a) != re.sub(LANG_VALUE, "", b):
        whole = ((0, len(a)), (0, len(b)))
        out.append(Defect("prologue", "prologue (xml decl / doctype / <html>) differs", *whole, *whole))
    steps = difflib.SequenceMatcher(None, [_shape(x) for x in o.toks], [_shape(x) for x in t.toks], autojunk=False).get_opcodes()
    moved = moves(o, t, steps, cfg["block_text_min"], cfg["block_text_ratio"])
    for k, (what, i1, i2, j1, j2) in enumerate(steps):
        if what == "equal":
            pairs = list(zip(range(i1, i2), range(j1, j2), strict=True))
            for i, j in pairs:
                x, y = o.toks[i], t.toks[j]
                if x.kind in ("open", "void") and _signed(x) != _signed(y):
                    out.append(Defect("attr", f"attribute differs on <{x.name}>: orig {_listed(x.attrs)} vs trad {_listed(y.attrs)}", (x.start, x.end), (y.start, y.end), o.context[i], t.context[j]))
            for i, j in pairs:
                if i in o.prose and j in t.prose and not hints.intersection(o.toks[i].classes):
                    out += _content(o, t, i, j, cfg)
            continue
        left, right = o.toks[i1:i2], t.toks[j1:j2]
        if k in moved or not any(x.tag for x in [*left, *right]):
            continue
        if what == "delete":
            whole = any(x.kind == "open" and x.name in BLOCKS for x in left)
            kind, detail = ("missing_block", "missing block") if whole else ("missing_tag", "missing tag")
            detail += f" <{o.names(i1, i2)}>"
        elif what == "insert":
            kind, detail = "extra_tag", f"extra tag <{t.names(j1, j2)}> in translation"
        else:
            kind, detail = "wrong_tag", f"tag mismatch: orig <{o.names(i1, i2)}> vs trad <{t.names(j1, j2)}>"
        inside = lambda side, i: side.context[i] if i < len(side.toks) else None
        out.append(Defect(kind, detail, o.span(i1, i2), t.span(j1, j2), inside(o, i1), inside(t, j1)))
    if well_formed and (error := parse_error(trad)) and "undefined entity" not in error:
        out.append(Defect("parse_error", f"not well-formed: {error}"))
    return out


SPAN = "struct<s:int,e:int>"
SCHEMA = f"seq int, kind string, detail string, orig_span {SPAN}, trad_span {SPAN}, block_orig {SPAN}, block_trad {SPAN}"
_SPAN = pa.struct([("s", pa.int32()), ("e", pa.int32())])


def defects(pairs: DataFrame, cfg: dict | None = None, well_formed: bool = False) -> DataFrame:
    """``(doc_id, seq, kind, detail, spans)`` of every pair; clean ones have no rows."""

    def rows(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for seq, d in enumerate(analyze(a or "", b or "", cfg, well_formed)):
                    spans = [s and {"s": s[0], "e": s[1]} for s in (d.orig, d.trad, d.block_orig, d.block_trad)]
                    for col, v in zip(cols, (doc, seq, d.kind, d.detail, *spans), strict=True):
                        col.append(v)
            kinds = [batch.column(0).type, pa.int32(), pa.string(), pa.string(), _SPAN, _SPAN, _SPAN, _SPAN]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "seq", "kind", "detail", "orig_span", "trad_span", "block_orig", "block_trad"])

    kind = pairs.schema["doc_id"].dataType.simpleString()
    return pairs.select("doc_id", "orig", "trad").mapInArrow(rows, f"doc_id {kind}, {SCHEMA}")


def first_defects(pairs: DataFrame, cfg: dict | None = None, most: int = 3) -> DataFrame:
    """``pairs`` with ``struct_reason``, its first defects, or null for none; a row for each row."""

    def rows(batches):
        for batch in batches:
            orig, trad = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("orig", "trad"))
            found = ("; ".join(d.detail for d in analyze(a or "", b or "", cfg)[:most]) or None for a, b in zip(orig, trad, strict=True))
            yield batch.append_column("struct_reason", pa.array(found, pa.string()))

    return pairs.mapInArrow(rows, T.StructType([*pairs.schema.fields, T.StructField("struct_reason", T.StringType())]))


def blamed_units(found: DataFrame, units: DataFrame) -> DataFrame:
    """``(doc_id, idx, reason)``: the first defect that falls into each unit.

    A defect without a place blames every unit of its document.
    """
    place = F.coalesce("block_trad", "trad_span")
    spans = found.select("doc_id", "seq", "detail", place.alias("span"))
    hit = (F.col("span").isNull()) | ((F.col("span.s") < F.col("end")) & (F.col("span.e") > F.col("start")))
    return units.select("doc_id", "idx", "start", "end").join(spans, "doc_id").where(hit).groupBy("doc_id", "idx").agg(F.min_by("detail", "seq").alias("reason"))
