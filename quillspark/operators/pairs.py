"""Document pairs: an original and a deterministically changed version.

The mutation is chosen by the document's number, so that each kind of defect
occurs on known documents.  The expressions are plain string functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import rewrite_lang

#: By number modulo 8; the same text runs in any SQL engine.
MUTATIONS = {
    0: "html",
    1: "replace(html, '</h1>', '')",
    2: "concat(left(html, instr(html, '<li>') - 1), substring(html, instr(html, '</li>') + 5))",
    3: "replace(html, 'href=\"/', 'href=\"/x/')",
    4: "left(html, cast(floor(length(html) * 0.4) as int))",
    5: "replace(html, '</h1>', '…</h1>')",
    6: "replace(html, 'class=\"ad\"', 'class=\"ads\"')",
    7: "replace(html, '<h1>', '<h1>however ')",
}
CASE = "case page_id % 8 " + " ".join(f"when {k} then {v}" for k, v in MUTATIONS.items()) + " end"


def pairs(pages: DataFrame, code: str = "it") -> DataFrame:
    """``(doc_id, orig, trad)``; the language changes except on every 16th document."""
    made = pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("orig"), F.expr(CASE).alias("trad"))
    return made.withColumn("trad", F.when(F.col("doc_id") % 16 == 15, F.col("trad")).otherwise(rewrite_lang(F.col("trad"), code)))
