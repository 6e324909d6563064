"""Lexing: documents to token tables, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import dims

NAME = r"[A-Za-z][\p{L}\p{N}_:.\-]*"
#: Every character falls under one alternative; quoted text never ends a tag.
#: Loops are possessive, so that long tags need no stack.
TOKEN = (
    r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<![^>]*>|<\?.*?\?>"
    rf"|</\s*{NAME}\s*>"
    rf"""|<{NAME}[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""
    r"|<|[^<]+"
)
ATTRIBUTE = r"""([A-Za-z_:][\p{L}\p{N}_:.\-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?"""


def raw_tokens(html: Column) -> Column:
    """The source cut into tokens; joined, they are the source again."""
    return F.regexp_extract_all(html, F.lit(TOKEN), 0)


def kind_of(raw: Column) -> Column:
    name = name_of(raw)
    return (
        F.when(raw.startswith("<!--") & (F.length(raw) > 4), "comment")
        .when(raw.startswith("<![CDATA["), "cdata")
        .when(raw.startswith("<!"), "decl")
        .when(raw.startswith("<?"), "pi")
        .when(raw == "<", "lt")
        .when(raw.startswith("</"), "close")
        .when(raw.startswith("<"), F.when(name.isin(*dims.VOID), "void").otherwise("open"))
        .otherwise("text")
    )


def name_of(raw: Column) -> Column:
    """Lower-case tag name; empty for what isn't a tag."""
    return F.lower(F.regexp_extract(raw, rf"^</?\s*({NAME})", 1))


def attributes(raw: Column) -> Column:
    """``(name, value)`` of a start tag; quotes are gone, a lone name has no value."""
    inside = F.regexp_extract(raw, rf"(?s)^<{NAME}(.*?)/?>$", 1)
    part = [F.regexp_extract_all(inside, F.lit(ATTRIBUTE), g) for g in (1, 2, 3, 4)]
    zipped = F.arrays_zip(*[p.alias(f"g{i}") for i, p in enumerate(part)])
    return F.transform(zipped, lambda z: F.struct(z["g0"].alias("name"), F.concat(z["g1"], z["g2"], z["g3"]).alias("value")))


def signature(attrs: Column) -> Column:
    """Attributes in order, those of language left out."""
    return F.array_sort(F.filter(attrs, lambda a: ~a["name"].isin(*dims.LANG_ATTRS)))


def tokens(docs: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(doc_id, pos, raw, kind, name)``: narrow, no shuffle.

    Null and empty documents have no tokens.
    """
    cut = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(raw_tokens(F.col(html_col))).alias("pos", "raw"))
    return cut.select("doc_id", "pos", "raw", kind_of(F.col("raw")).alias("kind"), name_of(F.col("raw")).alias("name"))


def in_document() -> Window:
    return Window.partitionBy("doc_id").orderBy("pos")


def with_offsets(toks: DataFrame) -> DataFrame:
    """Adds ``start`` and ``end`` in code points; one shuffle by document.

    Lengths are taken first, so that token texts take part in the shuffle only
    where they are asked for afterwards.
    """
    sized = toks.withColumn("_size", F.length("raw"))
    end = F.sum("_size").over(in_document())
    return sized.withColumn("end", end).withColumn("start", F.col("end") - F.col("_size")).drop("_size")


class Tokens:
    """``tokens(html)`` for lateral use in SQL: the rows of :func:`tokens` with their places."""

    def eval(self, html: str):
        from quillspark.operators.segment import lex

        for pos, t in enumerate(lex(html or "")):
            yield pos, t.raw, t.kind, t.name, t.start, t.end


def register(spark: SparkSession) -> None:
    """Make ``tokens`` known to SQL: ``SELECT * FROM pages, LATERAL tokens(html)``."""
    spark.udtf.register("tokens", F.udtf(Tokens, returnType="pos int, raw string, kind string, name string, start int, end int"))
