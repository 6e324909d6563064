"""Toxicity by weak supervision.

Many voters look at each text: fixed lexicons, lexicons of word beginnings
mined from labelled rows, and patterns over their hits.  A generative model
with a latent class explains how often each combination of votes occurs in
the whole corpus: every voter has an accuracy in each class, and voters that
go together are tied by a tree of pairwise dependencies (the tree with the
largest conditional mutual information), so that echoes aren't counted as
independent evidence.  A logistic classifier over hit statistics is then
trained on the posterior labels, by Newton steps over the whole corpus.

Vote combinations number 2**VOTERS at most; they and the Newton sums are all
that reaches the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, keyed, texts, words_of, written

#: Whole words, lower case.
LEXICONS = (
    frozenset("idiot idiots moron morons stupid dumb imbecile fool dummkopf imbécil estúpido stupide débile".split()),
    frozenset("trash scum worthless garbage filth vermin abschaum basura ordure escoria".split()),
    frozenset("pathetic disgusting clown loser losers jerk ugly freak ekelhaft asqueroso patético dégoûtant pathétique".split()),
)
MINED = 6
HITS = len(LEXICONS) + MINED
PATTERNS = ("two kinds of hits", "one word in fifty", "shouting")
VOTERS = HITS + len(PATTERNS)
SHORTEST, LONGEST = 3, 6


def starts_of(word: bytes) -> list[str]:
    """The beginnings of 3 to 6 letters that a mined lexicon may hold, and the word."""
    w = word.decode("utf-8", "replace")
    return [w[:k] + "*" for k in range(SHORTEST, min(LONGEST, len(w)) + 1)] + [w]


# ---- mined lexicons ----


def token_counts(sample: DataFrame) -> DataFrame:
    """``(token, toxic, clean)``: documents of ``(text, label)`` with each token."""

    def rows(batches):
        counts = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(texts(batch), batch.column("label").to_pylist(), strict=True):
                counts[label].update({t for w in set(words_of(text)) for t in starts_of(w)})
        tokens = list(set(counts[0]) | set(counts[1]))
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array([counts[1][t] for t in tokens], pa.int64()), pa.array([counts[0][t] for t in tokens], pa.int64())], ["token", "toxic", "clean"])

    parts = sample.select("text", "label").mapInArrow(rows, "token string, toxic long, clean long")
    return parts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def mine(docs: DataFrame, labels: DataFrame, size: int = 200, max_rows: int = 20_000, precision: float = 0.9, evidence: float = 27.0) -> list[str]:
    """Up to ``size`` tokens that mark toxic texts, strongest first.

    ``labels (doc_id, label)`` are the rows to learn from.  About ``max_rows``
    of them, those with the smallest id hashes, are looked up in ``docs
    (doc_id, text)``; being that few narrow rows, they are broadcast.  Copies
    count once.  A token needs the given share of toxic among the documents
    with it, and twice ``evidence / 2`` nats against the overall share.  What
    only extends a stronger token is left out.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").select("doc_id", "label").distinct()
    share = min(1.0, max_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label").dropDuplicates(["text", "label"]), "toxic-sample")
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("y")).first()
    if not 0 < total["y"] < total["n"]:
        return []
    base = total["y"] / total["n"]
    n, p = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    q = 1 - p
    gain = 2 * n * (p * F.log(p / base) + F.when(q > 0, q * F.log(q / (1 - base))).otherwise(0.0))
    strong = token_counts(sample).where((p >= precision) & (p > base)).withColumn("gain", gain).where(F.col("gain") >= evidence)
    out: list[str] = []
    held: dict[str, tuple[int, int]] = {}  # by beginning: the counts of the commonest chosen token with it
    for r in strong.orderBy(F.desc("gain"), F.desc(F.length("token")), "token").limit(20 * size).collect():
        stem = r["token"].rstrip("*")
        toxic, clean = held.get(stem, (0, 0))
        toxic, clean = r["toxic"] - toxic, max(0, r["clean"] - clean)  # what the token adds to those
        if toxic > 0 and toxic >= precision * (toxic + clean) and not any(o.endswith("*") and stem.startswith(o[:-1]) for o in out):
            out.append(r["token"])
            for k in range(1, len(stem) + 1):
                held[stem[:k]] = max(held.get(stem[:k], (0, 0)), (r["toxic"], r["clean"]))
        if len(out) == size:
            break
    return out


@dataclass
class Lexicon:
    """Which hit voter a word belongs to (-1: none), remembered by word."""

    mined: dict[str, int]
    seen: dict[bytes, int] = field(default_factory=dict)

    def voter(self, word: bytes) -> int:
        found = self.seen.get(word)
        if found is None:
            w = word.decode("utf-8", "replace")
            found = next((k for k, words in enumerate(LEXICONS) if w in words), -1)
            if found < 0:
                found = next((self.mined[t] for t in starts_of(word) if t in self.mined), -1)
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[word] = found
        return found

    def __getstate__(self):
        return {"mined": self.mined, "seen": {}}


def lexicon(tokens: list[str]) -> Lexicon:
    """Mined tokens dealt over the mined voters in turn, strongest first."""
    return Lexicon({t: len(LEXICONS) + i % MINED for i, t in enumerate(tokens)})


STATISTICS = VOTERS + 6


def examined(text: str, lex: Lexicon) -> tuple[int, list[float]]:
    """The votes of a whole text as bits, and the classifier's statistics."""
    words = words_of(text)
    seen, voter = lex.seen, lex.voter
    hits: list[tuple[bytes, int]] = []
    for w in words:
        k = seen.get(w)
        if k is None:
            k = voter(w)
        if k >= 0:
            hits.append((w, k))
    counts = [0] * HITS
    for _, k in hits:
        counts[k] += 1
    kinds, n = len({w for w, _ in hits}), len(words)
    loud = text.count("!") / (n + 1)
    fired = [c > 0 for c in counts] + [kinds >= 2, len(hits) * 50 >= n > 0 and bool(hits), loud > 0.3]
    votes = sum(1 << i for i, f in enumerate(fired) if f)
    stats = [float(f) for f in fired] + [math.log1p(len(hits)), min(kinds, 4) / 4, math.log1p(100 * len(hits) / (n + 1)), float(bool(hits)), math.log1p(n) / 10, min(1.0, loud)]
    return votes, stats


def examine(df: DataFrame, lex: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, votes int, x array<double>)``, a row per row; null is empty."""

    def rows(batch):
        found = [examined(t, lex) for t in texts(batch)]
        return {"doc_id": batch.column("doc_id"), "votes": pa.array([v for v, _ in found], pa.int32()), "x": pa.array([x for _, x in found], pa.list_(pa.float64()))}

    src = keyed(df, doc_id=id_col, text=text_col)
    return arrow_map(src, rows, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, votes int, x array<double>")


# ---- the label model ----


@dataclass(frozen=True)
class LabelModel:
    """Class prior, tree parents, and P(vote | parent's vote, class) of each voter."""

    prior: float
    parent: tuple[int, ...]
    table: np.ndarray  # (voter, class, parent's vote) -> P(fires)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes) for bit patterns."""
        logs = np.log(np.array([1 - self.prior, self.prior]))[None, :].repeat(len(votes), 0)
        fired = (votes[:, None] >> np.arange(len(self.parent))) & 1
        for i, parent in enumerate(self.parent):
            above = fired[:, parent] if parent >= 0 else np.zeros(len(votes), int)
            p = self.table[i][:, above].T
            logs += np.log(np.where(fired[:, i : i + 1] == 1, p, 1 - p))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -60, 60)))


    def accuracies(self) -> list[tuple[float, float]]:
        """P(fires | toxic) and P(silent | clean) of each voter, whatever its parent says."""
        memo: dict[tuple[int, int], float] = {}

        def fires(i: int, y: int) -> float:
            if (i, y) not in memo:
                above = fires(self.parent[i], y) if self.parent[i] >= 0 else 0.0
                memo[i, y] = float((1 - above) * self.table[i, y, 0] + above * self.table[i, y, 1])
            return memo[i, y]

        return [(fires(i, 1), 1 - fires(i, 0)) for i in range(len(self.parent))]


def _tree(fired: np.ndarray, weight: np.ndarray) -> tuple[int, ...]:
    """Parents in the maximum spanning tree of conditional mutual information.

    ``weight`` is (pattern, class).
    """
    v = fired.shape[1]
    info = np.zeros((v, v))
    total = max(weight.sum(), 1e-9)
    for y in (0, 1):
        w = weight[:, y]
        n = max(w.sum(), 1e-9)
        one = (fired.T @ w + 0.5) / (n + 1)
        both = (fired.T @ (fired * w[:, None]) + 0.25) / (n + 1)
        for a in (0, 1):
            for b in (0, 1):
                joint = both if a and b else one[:, None] - both if a else one[None, :] - both if b else 1 - one[:, None] - one[None, :] + both
                joint = np.clip(joint, 1e-9, 1)
                marginal = np.clip(np.outer(one if a else 1 - one, one if b else 1 - one), 1e-9, 1)
                info += n / total * joint * np.log(joint / marginal)
    parent, inside = [-1] * v, [0]
    while len(inside) < v:
        _, i, j = max((info[i, j], -i, -j) for i in inside for j in range(v) if j not in inside)
        parent[-j] = -i
        inside.append(-j)
    return tuple(parent)


def fit_labels(votes: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, voters: int = VOTERS, hits: int = HITS, rounds: int = 60, prior: float = 0.1, trust: float = 5.0) -> LabelModel:
    """EM over vote patterns and how often they occur.

    ``known`` is the label of a pattern's rows where they have one (else -1);
    such rows keep it and count ``trust`` times, which holds the classes to
    what the labels mean.  The start is the guess that whatever a lexicon hits
    is toxic.  Tables are smoothed by a pseudo-count for each class.
    """
    fired = ((votes[:, None] >> np.arange(voters)) & 1).astype(float)
    known = np.full(len(votes), -1) if known is None else known
    counts = np.where(known >= 0, trust, 1.0) * counts
    post = np.where(known >= 0, known, np.where(fired[:, :hits].any(1), 0.9, 0.02))
    model = LabelModel(prior, tuple([-1] * voters), np.full((voters, 2, 2), 0.5))
    for _ in range(rounds):
        weight = counts[:, None] * np.stack([1 - post, post], 1)
        parent = _tree(fired, weight)
        table = np.empty((voters, 2, 2))
        for i, p in enumerate(parent):
            above = fired[:, p] if p >= 0 else np.zeros(len(votes))
            for y in (0, 1):
                for a in (0, 1):
                    w = weight[:, y] * (above == a)
                    table[i, y, a] = (w @ fired[:, i] + (0.02, 1.0)[y]) / (w.sum() + (2.0, 4.0)[y])
        model = LabelModel(float((weight[:, 1].sum() + 1) / (counts.sum() + 10)), parent, np.clip(table, 1e-6, 1 - 1e-6))
        new = np.where(known >= 0, known, model.posterior(votes))
        done = np.abs(new - post).max() < 1e-6 if len(post) else True
        post = new
        if done:
            break
    return model


def label_model(found: DataFrame, labels: DataFrame) -> LabelModel:
    """Fit on the vote patterns of the whole corpus and ``labels (doc_id, label)``."""
    some = found.select("doc_id", "votes").join(labels.where("label in (0, 1)").select("doc_id", "label").distinct(), "doc_id")
    all_rows = found.groupBy("votes").agg(F.count("*").alias("n"))
    with_label = some.groupBy("votes", "label").agg(F.count("*").alias("n"))
    total = {r["votes"]: r["n"] for r in all_rows.collect()}
    known = {(r["votes"], r["label"]): r["n"] for r in with_label.collect()}
    rows = [(v, -1, max(0, n - sum(known.get((v, y), 0) for y in (0, 1)))) for v, n in sorted(total.items())]
    rows += [(v, y, n) for (v, y), n in sorted(known.items())]
    votes, label, n = (np.array(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return fit_labels(votes.astype(np.int64), n.astype(float), label)


# ---- the classifier ----


def _batch(batch) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, STATISTICS)
    return np.hstack([np.ones((batch.num_rows, 1)), x]), np.array(batch.column("votes").to_pylist(), np.int64)


def train(found: DataFrame, model: LabelModel, steps: int = 8, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton's method on the posterior labels.

    Each step is one pass over the statistics; gradient and Hessian are summed
    in each partition, then by Spark.  ``ridge`` counts as that many documents.
    """
    d = STATISTICS + 1
    w = np.zeros(d)
    for _ in range(steps):

        def sums(batches, w=w):
            total = np.zeros((d, d + 1))
            for batch in batches:
                x, votes = _batch(batch)
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                total[:, :d] += (x * (p * (1 - p))[:, None]).T @ x
                total[:, d] += x.T @ (model.posterior(votes) - p)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["entry", "value"])

        total = np.zeros(d * (d + 1))
        for r in found.select("votes", "x").mapInArrow(sums, "entry long, value double").groupBy("entry").agg(F.sum("value").alias("value")).collect():
            total[r["entry"]] = r["value"]
        total = total.reshape(d, d + 1)
        step = np.linalg.solve(total[:, :d] + ridge * np.eye(d), total[:, d] - ridge * w)
        w = w + step * min(1.0, 8.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-3:
            break
    return w


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, votes, posterior, score)``: the whole method over ``df``.

    ``labels (doc_id, label)`` are the rows that may be learned from (label 0
    or 1); none: only the fixed lexicons count.  Empty and null
    texts have no votes and a low score; repeated rows are each scored; an
    empty table has an empty result.
    """
    docs = keyed(df, doc_id=id_col, text=text_col)
    found = written(examine(docs, lexicon(mine(docs, labels))), "votes")
    model = label_model(found, labels)
    w = train(found, model)

    def rows(batch):
        x, votes = _batch(batch)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        return {"doc_id": batch.column("doc_id"), "votes": batch.column("votes"), "posterior": pa.array(model.posterior(votes)), "score": pa.array(p)}

    kind = found.schema["doc_id"].dataType.simpleString()
    return arrow_map(found, rows, f"doc_id {kind}, votes int, posterior double, score double")
