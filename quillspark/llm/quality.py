"""Quality classifier: quadratic discriminant over document statistics.

Each class has a mean and a covariance of the transformed statistics, shrunk
towards the pooled covariance and a diagonal.  Scores come from the difference
of the classes' log densities: Mahalanobis distances by forward substitution
with Cholesky factors that are computed once and sent to the workers.

Fitting needs only each class's count, sum and sum of outer products, summed
per partition first, so all labelled rows take part.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, keyed, texts, written

NAMES = ("length", "words", "word_length", "distinct_words", "commonest_word", "repeated_words", "distinct_pairs", "repeated_lines", "upper", "symbols", "bars", "digits", "stops", "short_words", "line_words")
SYMBOLS = b"#$%&*!@~^=+<>{}[]\\/_"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _share(part: float, whole: float, prior: float = 0.5) -> float:
    """Log-odds of a share, drawn in a little so that 0 and 1 stay finite."""
    return math.log((part + prior) / (max(0.0, whole - part) + prior))


def _rate(part: float, whole: float) -> float:
    """Log of a rate with a floor that doesn't depend on the length of the text."""
    return math.log(part / max(1.0, whole) + 0.002)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text, in the order of ``NAMES``."""
    raw = (text or "").encode("utf-8", "replace")
    n, words = len(raw), raw.split()
    w, lines = max(1, len(words)), raw.split(b"\n")
    pairs = len(set(zip(words, words[1:], strict=False)))
    without = lambda chars: n - len(raw.translate(None, chars))
    common = Counter(words).most_common(1)[0][1] if words else 0
    short = sum(1 for x in map(len, words) if x <= 3)
    return [
        math.log1p(n),
        math.log1p(len(words)),
        math.log((n + 1) / w),
        math.log((len(set(words)) + 1) / (w + 1)),
        _rate(max(0, common - 1), w),
        _rate(sum(map(eq, words, words[1:])), w),
        math.log((pairs + 1) / w),
        _rate(len(lines) - len(set(lines)), len(lines)),
        _rate(without(UPPER), n),
        _rate(without(SYMBOLS), n),
        _rate(raw.count(b"|"), w),
        _rate(without(b"0123456789"), n),
        _rate(without(b".,"), w),
        _rate(short, w),
        math.log1p(len(words) / len(lines)),
    ]


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, x array<double>)``, a row per row; a null text is an empty one."""

    def rows(batch):
        return {"doc_id": batch.column("doc_id"), "x": pa.array([statistics(t) for t in texts(batch)], pa.list_(pa.float64()))}

    src = keyed(df, doc_id=id_col, text=text_col)
    return arrow_map(src, rows, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors, log-determinants and prior log-odds."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of statistics."""
        z = (x - self.center) / self.scale
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            y = np.clip((z - mean) @ factor.T, -1e6, 1e6)
            logs.append(offset - 0.5 * np.einsum("ij,ij->i", y, y))
        return 0.5 * (1 + np.tanh(0.5 * np.clip(logs[1] - logs[0], -60, 60)))


def moments(labelled: DataFrame) -> list[tuple[int, float, np.ndarray, np.ndarray]]:
    """Each class's ``(label, count, sum, sum of outer products)`` of ``(x, label)``.

    Partial sums of every partition are added up by Spark, entry by entry;
    what reaches the driver has the size of two covariance matrices.
    """
    d = len(NAMES)

    def rows(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            y = np.array(batch.column("label").to_pylist())
            x = np.array(batch.column("x").to_pylist(), float).reshape(len(y), d)
            x1 = np.hstack([np.ones((len(y), 1)), x])
            for label in (0, 1):
                part = x1[y == label]
                sums[label] = sums.get(label, 0) + part.T @ part
        for label, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * m.size), pa.array(np.arange(m.size)), pa.array(m.ravel())], ["label", "entry", "value"])

    parts = labelled.select("x", "label").mapInArrow(rows, "label long, entry long, value double")
    out: dict[int, np.ndarray] = {}
    for r in parts.groupBy("label", "entry").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r["label"], np.zeros((d + 1) ** 2))[r["entry"]] = r["value"]
    full = {k: m.reshape(d + 1, d + 1) for k, m in out.items()}
    return [(k, m[0, 0], m[0, 1:], m[1:, 1:]) for k, m in sorted(full.items())]


def fit(labelled: DataFrame, shrink: float = 0.3, ridge: float = 0.05) -> Discriminant:
    """Fit on ``(x, label)`` with labels 0 and 1; others and nulls are left out.

    A class without rows takes the pooled mean, so that its score is the prior
    of one row; without any rows every score is a half.
    """
    d = len(NAMES)
    found = {k: (n, s, m) for k, n, s, m in moments(labelled.where("label in (0, 1) and x is not null"))}
    total = sum((n for n, _, _ in found.values()), 0.0)
    s_all = sum((s for _, s, _ in found.values()), np.zeros(d))
    m_all = sum((m for _, _, m in found.values()), np.zeros((d, d)))
    center = s_all / max(1.0, total)
    scale = np.sqrt(np.maximum(np.diag(m_all) / max(1.0, total) - center**2, 1e-6))
    pooled, classes = np.zeros((d, d)), {}
    for k in (0, 1):
        n, s, m = found.get(k, (0.0, np.zeros(d), np.zeros((d, d))))
        mean = s / n if n else center
        cov = (m / n - np.outer(mean, mean)) / np.outer(scale, scale) if n else np.eye(d)
        classes[k] = (n, (mean - center) / scale, cov)
        pooled += n * cov
    pooled = pooled / total if total else np.eye(d)
    means, factors, offsets = [], [], []
    for k in (0, 1):
        n, mean, cov = classes[k]
        mixed = (1 - shrink) * cov + shrink * pooled
        mixed += ridge * np.eye(d)
        lower = np.linalg.cholesky(mixed)
        means.append(mean)
        factors.append(np.linalg.inv(lower))
        offsets.append(math.log((n + 1) / (total + 2)) - np.log(np.diag(lower)).sum())
    return Discriminant(center, scale, np.array(means), np.array(factors), np.array(offsets))


def score(feats: DataFrame, model: Discriminant) -> DataFrame:
    """``(doc_id, score)`` of ``(doc_id, x)``."""

    def rows(batch):
        x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, len(NAMES))
        return {"doc_id": batch.column("doc_id"), "score": pa.array(model.scores(x), pa.float64())}

    return arrow_map(feats.select("doc_id", "x"), rows, f"doc_id {feats.schema['doc_id'].dataType.simpleString()}, score double")


def labelled(feats: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """``(x, label)``: statistics of the documents that have a label."""
    y = keyed(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label in (0, 1)").withColumn("label", F.col("label").cast("long")).distinct()
    return feats.join(y, "doc_id").select("x", "label")


def train(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> Discriminant:
    """Fit on about ``max_rows`` labelled documents, those with the smallest id hashes.

    Being that few narrow rows, their labels are broadcast, and only their
    texts are looked at; their statistics are written.  Labels other than 0 and
    1, and null ids, are left out.
    """
    known = keyed(labels, doc_id=id_col, label=label_col).where("doc_id is not null and label in (0, 1)").distinct()
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts_of = keyed(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    feats = written(features(texts_of), "train-statistics")  # a task with two Python maps would take two workers, which stay
    return fit(labelled(feats, F.broadcast(chosen), "label"))


def keep(df: DataFrame, model: Discriminant, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with a score of ``threshold`` or more, unchanged."""

    def run(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            x = np.array([statistics(t) for t in text], float).reshape(batch.num_rows, len(NAMES))
            yield batch.filter(pa.array(model.scores(x) >= threshold))

    return df.mapInArrow(run, df.schema)
