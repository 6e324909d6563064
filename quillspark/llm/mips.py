"""Exact top-k inner product search over vectors in order of length.

Vectors are rotated by the singular vectors of the whole set, which moves
their mass to the front, and laid out by descending length.  A block of
queries meets them in that order.  Products are summed over the front
coordinates first; what is left is at most the product of the two residual
lengths (Cauchy-Schwarz), so a vector is dropped for a query once its partial
sum and that bound stay under the query's k-th best so far.  When a whole
batch is too short for a query, no partial sum is made at all.  What survives
is scored in exact integers.

Vectors are rotated and measured once and lie in chunks of ``ROWS``, each with
the length of its longest; a chunk too short for every query isn't decoded.
Queries are met in blocks of bounded size, ``AT_ONCE`` of them in each job over
the chunks, so that what a task holds doesn't grow with the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import arrow_map, keyed, written

SCALE = 256
FRONTS = (0.5, 0.75)  # shares of the coordinates after which to prune
ROWS = 2048  # vectors in a chunk, and in one matrix product
AT_ONCE = 8  # blocks of queries that one job over all chunks answers


def integers(values: list) -> np.ndarray | None:
    """``floor(256 * x)`` of each component; None if one is null or not finite."""
    if values is None or any(v is None for v in values):
        return None
    x = np.asarray(values, float)
    return np.floor(SCALE * x).astype(np.int64) if np.isfinite(x).all() else None


def prepared(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(row, vec_id, v array<long>, norm)`` of the vectors that take part.

    Null vectors and those with null or non-finite components are left out.
    """

    def rows(batch):
        vs = [integers(v) for v in batch.column("v").to_pylist()]
        kept = [i for i, v in enumerate(vs) if v is not None]
        norms = [float(np.sqrt((vs[i].astype(float) ** 2).sum())) for i in kept]
        return {"row": batch.column("row").take(pa.array(kept, pa.int64())), "vec_id": batch.column("vec_id").take(pa.array(kept, pa.int64())), "v": pa.array([vs[i] for i in kept], pa.list_(pa.int64())), "norm": pa.array(norms, pa.float64())}

    src = keyed(df, vec_id=id_col, v=vector_col).withColumn("row", F.monotonically_increasing_id()).where("v is not null")
    return arrow_map(src, rows, "row long, vec_id long, v array<long>, norm double")


def _matrix(lists: list, d: int) -> np.ndarray:
    """Integer rows of width ``d``; shorter ones are padded with zeros."""
    out = np.zeros((len(lists), d), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Right singular vectors of all ``vectors``, by descending singular value.

    They are the eigenvectors of the d x d Gram matrix, summed per partition
    and then by Spark.
    """

    def sums(batches):
        total = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch.column("v").to_pylist(), d).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], ["entry", "value"])

    gram = np.zeros(d * d)
    for r in vectors.select("v").mapInArrow(sums, "entry long, value double").groupBy("entry").agg(F.sum("value").alias("value")).collect():
        gram[r["entry"]] = r["value"]
    gram = gram.reshape(d, d)
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


def fronts_of(d: int) -> list[int]:
    """After how many coordinates products are pruned."""
    return sorted({max(1, int(d * s)) for s in FRONTS}) if d else []


@dataclass
class Chunk:
    """Vectors in order of length: whole ones, rotated, and what is left after each front."""

    rows: np.ndarray
    ids: np.ndarray
    v: np.ndarray
    x: np.ndarray
    norms: np.ndarray
    rests: list[np.ndarray]

    @staticmethod
    def of(rows: np.ndarray, ids: np.ndarray, v: np.ndarray, basis: np.ndarray) -> Chunk:
        x = v.astype(float) @ basis
        return Chunk(rows, ids, v, x, np.sqrt((x**2).sum(1)), [np.sqrt((x[:, f:] ** 2).sum(1)) for f in fronts_of(v.shape[1])])

    def row(self) -> dict:
        """As a row of a table."""
        flat = {"rows": self.rows, "ids": self.ids, "v": self.v, "x": self.x, "norms": self.norms, "rests": np.array(self.rests)}
        return {"longest": float(self.norms.max(initial=0.0))} | {k: np.ascontiguousarray(a).tobytes() for k, a in flat.items()}

    @staticmethod
    def read(row: dict, d: int) -> Chunk:
        part = {k: np.frombuffer(row[k], np.int64 if k in ("rows", "ids", "v") else float) for k in ("rows", "ids", "v", "x", "norms", "rests")}
        n = len(part["rows"])
        return Chunk(part["rows"], part["ids"], part["v"].reshape(n, d), part["x"].reshape(n, d), part["norms"], list(part["rests"].reshape(-1, n)))


CHUNK = "longest double, rows binary, ids binary, v binary, x binary, norms binary, rests binary"


def chunked(laid: DataFrame, basis: np.ndarray) -> DataFrame:
    """``laid (row, vec_id, v)`` as chunks, in the order of its rows."""
    d = len(basis)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                ids = np.array([_id(x) for x in part.column("vec_id").to_pylist()], np.int64)
                made = Chunk.of(part.column("row").to_numpy(), ids, _matrix(part.column("v").to_pylist(), d), basis).row()
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in made.values()], names=list(made))

    return laid.select("row", "vec_id", "v").mapInArrow(run, CHUNK)


@dataclass
class Block:
    """A block of queries, rotated, and the best found for each so far."""

    rows: np.ndarray
    v: np.ndarray
    basis: np.ndarray
    k: int
    floor: np.ndarray  # a score that k others are known to reach

    def __post_init__(self):
        self.start()

    def start(self) -> None:
        self.fronts = fronts_of(self.v.shape[1])
        self.q = self.v.astype(float) @ self.basis
        self.norm = np.sqrt((self.q**2).sum(1))
        self.rest = [np.sqrt((self.q[:, f:] ** 2).sum(1)) for f in self.fronts]
        n = len(self.rows)
        self.best = np.full((n, self.k), np.iinfo(np.int64).min)
        self.ids = np.full((n, self.k), np.iinfo(np.int64).max)
        self.seen_rows = np.full((n, self.k), np.iinfo(np.int64).max)

    def need(self, longest: float) -> np.ndarray:
        """The least product that could still count, with some slack for rounding."""
        return np.maximum(self.floor, self.best[:, -1].astype(float)) - (1e-9 * longest * self.norm + 1e-6)

    def live(self, longest: float) -> np.ndarray:
        """Queries that vectors up to that length could matter to."""
        return np.flatnonzero(longest * self.norm >= self.need(longest))

    def meet(self, chunk: Chunk) -> None:
        """Meet the vectors of a chunk, by partial products first."""
        longest = float(chunk.norms.max(initial=0.0))
        live, need = self.live(longest), self.need(longest)
        if not len(live):
            return
        sums = np.zeros((len(chunk.rows), len(live)))
        keep, at = np.ones(sums.shape, bool), 0
        for f, rest, own in zip(self.fronts, chunk.rests, self.rest, strict=True):
            sums += chunk.x[:, at:f] @ self.q[live, at:f].T
            keep &= sums + rest[:, None] * own[live][None, :] >= need[live][None, :]
            at = f
        r, c = np.nonzero(keep)
        q = live[c]
        other = chunk.rows[r] != self.rows[q]
        r, q = r[other], q[other]
        if len(r):
            score = np.concatenate([np.einsum("ij,ij->i", chunk.v[r[j : j + 65536]], self.v[q[j : j + 65536]]) for j in range(0, len(r), 65536)])
            self._take(q, score, chunk.ids[r], chunk.rows[r])

    def _take(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        met = np.unique(q)
        held = np.repeat(met, self.k)
        q = np.concatenate([q, held])
        score, ids, rows = (np.concatenate([new, old[met].ravel()]) for new, old in ((score, self.best), (ids, self.ids), (rows, self.seen_rows)))
        order = np.lexsort((rows, ids, -score.astype(float), q)) if np.abs(score[score > np.iinfo(np.int64).min]).max(initial=0) < 2**52 else np.array(sorted(range(len(q)), key=lambda i: (q[i], -int(score[i]), ids[i], rows[i])))
        q, score, ids, rows = q[order], score[order], ids[order], rows[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        self.best[q[top], place[top]], self.ids[q[top], place[top]], self.seen_rows[q[top], place[top]] = score[top], ids[top], rows[top]

    def __getstate__(self):
        return {"rows": self.rows, "v": self.v, "basis": self.basis, "k": self.k, "floor": self.floor}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.start()


def top_k(df: DataFrame, is_query, k: int = 5, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest inner products.

    ``is_query`` is a condition on ``vec_id``; each such row is a query against
    every row but itself, ties to the smaller id.  Rows with a null id are
    never queries, and as candidates they come last among equals, with a null
    ``vec_id``.  Repeated rows are rows of their own.  Vectors of different
    lengths are padded with zeros; scores must fit in 64 bits.  Fewer than k
    others give fewer rows; no vectors, none.
    """
    spark = df.sparkSession
    flat = written(prepared(df, id_col, vector_col), "vectors")
    shape = flat.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d"), F.count_if(is_query).alias("n")).first()
    d, n = shape["d"], shape["n"]
    kind = "query_row long, query_id long, vec_id long, row long, score long"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    basis = rotation(flat, d)
    size = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = flat.repartitionByRange(size, F.desc("norm"), "row").sortWithinPartitions(F.desc("norm"), "row")
    chunks = written(chunked(laid, basis), "by-length")
    seed = Chunk.read(chunks.orderBy(F.desc("longest")).first().asDict(), d)
    blocks = -(-n // block)
    queries = written(flat.where(is_query).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))), "queries")

    found = []
    for b in range(0, blocks, AT_ONCE):
        by_block: dict[int, list] = {}
        for r in queries.where(F.col("block").between(b, b + AT_ONCE - 1)).collect():
            by_block.setdefault(r["block"], []).append(r)
        ready = []
        for asked in by_block.values():
            own = np.array([r["row"] for r in asked], np.int64), _matrix([r["v"] for r in asked], d)
            first = Block(*own, basis, k, np.full(len(asked), -np.inf))
            first.meet(seed)
            floor = np.where(first.best[:, -1] > np.iinfo(np.int64).min, first.best[:, -1].astype(float), -np.inf)
            ready.append((Block(*own, basis, k, floor), np.array([r["vec_id"] for r in asked], np.int64)))
        if not ready:
            continue
        sent = spark.sparkContext.broadcast(ready)

        def run(batches, sent=sent):
            for block, _ in sent.value:
                block.start()
            for batch in batches:
                for row in batch.to_pylist():
                    asking = [block for block, _ in sent.value if len(block.live(row["longest"]))]
                    if asking:
                        chunk = Chunk.read(row, d)
                        for block in asking:
                            block.meet(chunk)
            for block, names in sent.value:
                q, place = np.nonzero(block.seen_rows < np.iinfo(np.int64).max)
                ids = block.ids[q, place]
                yield pa.RecordBatch.from_arrays([pa.array(block.rows[q]), pa.array(names[q]), pa.array(ids, mask=ids == NO_ID), pa.array(block.seen_rows[q, place]), pa.array(block.best[q, place])], ["query_row", "query_id", "vec_id", "row", "score"])

        part = chunks.mapInArrow(run, kind)
        order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
        found.append(written(part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "found"))
        sent.unpersist()
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


#: Stands for a null id, after all others.
NO_ID = np.iinfo(np.int64).max - 1


def _id(x: int | None) -> int:
    return NO_ID if x is None else x
