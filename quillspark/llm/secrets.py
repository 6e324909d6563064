"""Secret scan with corpus-wide ownership frequency.

Each text yields candidates: keyword assignments, access keys, long hex runs
and, beyond these, long tokens of high entropy.  The hash of each candidate's
value is counted over distinct repositories and owners of the whole corpus.  A
value that several owners hold is a widely copied example; one that stays with
few looks live.  Entropy tokens are reported only if they look live; the other
kinds are always reported, with that mark.

Values leave the worker as SHA-256 only.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, keyed, texts, written

KINDS = ("assign", "access", "hex", "entropy")
BASE = KINDS[:3]


def either_case(word: str) -> str:
    """ASCII letters in either case and no others, unlike ``re.IGNORECASE``."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", word)


WORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({WORDS})["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # runs of [0-9a-f]+, shorter ones left out
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGIT = re.compile("[0-9]")
LEAST_ENTROPY = 3.5


def entropy(token: str) -> float:
    """Shannon entropy of the characters, in bits."""
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values())


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """``(kind, start, end, value)``, base kinds first, each from left to right.

    Entropy tokens have 20 characters or more, an upper-case letter, a
    lower-case one and a digit, 3.5 bits, and touch no base candidate.
    """
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    if DIGIT.search(text):
        taken = sorted((s, e) for _, s, e, _ in out)
        for m in TOKEN.finditer(text):
            t = m[0]
            mixed = DIGIT.search(t) and t.lower() != t and t.upper() != t
            if mixed and entropy(t) >= LEAST_ENTROPY and not any(s < m.end() and m.start() < e for s, e in taken):
                out.append(("entropy", m.start(), m.end(), t))
    return out


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


FOUND = "array<struct<kind:string,start:int,end:int,hash:string>>"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "repo", owner_col: str = "owner") -> DataFrame:
    """``(doc_id, repo, owner, found)``: every candidate of every whole text."""

    def rows(batch):
        found = [[{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "replace")).hexdigest()} for k, s, e, v in candidates(t)] for t in texts(batch)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))
        return {n: batch.column(n) for n in ("doc_id", "repo", "owner")} | {"found": pa.array(found, kind)}

    src = keyed(df, doc_id=id_col, text=text_col, repo=repo_col, owner=owner_col)
    names = ", ".join(f"{n} {src.schema[n].dataType.simpleString()}" for n in ("doc_id", "repo", "owner"))
    return arrow_map(src, rows, f"{names}, found {FOUND}")


def ownership(found: DataFrame) -> DataFrame:
    """``(hash, repos, owners, hits)`` over the whole corpus.

    Copies within one repository and owner are merged before the shuffle by
    hash; a null repository or owner counts as one of its own kind.
    """
    seen = found.select(F.explode("found.hash").alias("hash"), "repo", "owner").groupBy("hash", "repo", "owner").agg(F.count("*").alias("hits"))
    per_owner = seen.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("hits").alias("hits"))
    repos = seen.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("repos"))
    owners = per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("hits").alias("hits"))
    return repos.join(owners, "hash").select("hash", "repos", "owners", "hits")


def find(df: DataFrame, max_owners: int = 1, max_repos: int = 16, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "repo", owner_col: str = "owner") -> DataFrame:
    """``(doc_id, spans)``, a row per row; spans carry their ownership.

    ``spans`` is an array of ``(kind, start, end, hash, repos, owners, live)``
    by start, then kind; ``live`` means at most ``max_owners`` owners and
    ``max_repos`` repositories: what one owner copies to more of them is an
    example too.  Null and empty texts have no spans; repeated rows are each
    reported; texts are read whole whatever their length; further columns,
    however named, play no part.  An empty table has an empty result.
    """
    found = written(scan(df, id_col, text_col, repo_col, owner_col).withColumn("row", F.monotonically_increasing_id()), "candidates")
    some, none = found.where(F.size("found") > 0), found.where(F.size("found") == 0)
    owned = written(ownership(some), "ownership")
    each = some.select("row", F.explode("found").alias("c")).select("row", "c.*").join(owned, "hash", "left")
    each = each.withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)).where(F.col("kind").isin(*BASE) | F.col("live"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    span = F.struct("start", rank.alias("rank"), "kind", "end", "hash", "repos", "owners", "live")
    per_row = each.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    joined = some.select("row", "doc_id").join(per_row, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast(per_row.schema["spans"].dataType)).alias("spans"))
    empty = none.select("doc_id", F.array().cast(per_row.schema["spans"].dataType).alias("spans"))
    return joined.union(empty)
