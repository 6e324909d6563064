"""URL filter: allow and block rules, then a list of canonical URLs.

The list is held by a blocked Bloom filter: a table with a row for each block
of eight 64-bit words; an entry sets one bit in each word of its block.  URLs
that no rule decides are joined to the block of their hash (a small filter is
broadcast by its measured size, a large one shuffled) and what may be listed
goes on to an exact hash join, which removes the false positives.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import keyed, written

WORDS = 8
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are one expression; more of them belong into a table.
MOST_RULES = 500


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #``; else empty."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host and path without closing slashes; scheme, query and fragment are gone."""
    return F.concat(host, F.rtrim(path, F.lit("/")))


def canonical_url(url: Column) -> Column:
    return canonical(host_of(url), path_of(url))


def _matched(rules: Sequence[Rule], host: Column, path: Column, what: str) -> Column:
    out = F
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = out.when(fits, F.lit(getattr(rule, what)))
    return out.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def _bits(hash_col: Column) -> list[Column]:
    """One bit in each word, from six bits of the hash each."""
    six = [F.shiftrightunsigned(hash_col, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), n) for n in six]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """``(block, w0 .. w7)`` of the non-empty blocks for ``listed (url)``."""
    bits = _bits(F.xxhash64("url", F.lit(1)))
    rows = listed.select(F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", bits_per_url: int = 16) -> DataFrame:
    """``(page_id, host, path, rule, maybe_listed, listed, verdict)``, a row per row.

    The longest rule that fits the host or a parent domain and starts the path
    decides; where none fits, a URL whose canonical form is in ``listed`` (also
    canonical; nulls and repeats don't matter) is blocked and any other allowed.
    A null url, or one without ``://``, has empty host and path, fits no rule
    and is listed only if the empty string is.  Repeated rows stay.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    urls = written(keyed(listed, url=listed_col).where("url is not null").distinct(), "listed")
    blocks = max(1, -(-urls.count() * bits_per_url // (64 * WORDS)))
    held = written(bloom(urls, blocks), "bloom")

    src = keyed(pages, page_id=id_col, url=url_col)
    parsed = src.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    parsed = parsed.select("page_id", "host", "path", _matched(rules, host, path, "text").alias("rule"), _matched(rules, host, path, "verdict").alias("ruled"), canonical(host, path).alias("url"))
    ruled, rest = parsed.where("rule is not null"), parsed.where("rule is null")
    bits = _bits(F.xxhash64("url", F.lit(1)))
    present = F.lit(True)
    for i, bit in enumerate(bits):
        present = present & (F.col(f"w{i}").bitwiseAND(bit) != 0)
    probed = rest.withColumn("block", F.pmod(F.xxhash64("url"), F.lit(blocks))).join(held, "block", "left").withColumn("maybe", F.coalesce(present, F.lit(False)))
    probed = written(probed.select("page_id", "host", "path", "rule", "url", "maybe"), "probed")
    hits = probed.where("maybe").join(urls.withColumn("exact", F.lit(True)), "url", "left")

    def out(df: DataFrame, maybe: Column, found: Column, verdict: Column) -> DataFrame:
        return df.select("page_id", "host", "path", "rule", maybe.alias("maybe_listed"), found.alias("listed"), verdict.alias("verdict"))

    no, exact = F.lit(False), F.coalesce("exact", F.lit(False))
    return (
        out(ruled, no, no, F.col("ruled"))
        .union(out(probed.where("not maybe"), no, no, F.lit("allow")))
        .union(out(hits, F.lit(True), exact, F.when(exact, "block").otherwise("allow")))
    )
