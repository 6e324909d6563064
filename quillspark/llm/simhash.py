"""SimHash near-duplicates, with pigeonring filtering before the Hamming check.

Fingerprints are cut into a ring of ``segments``.  If two differ in at most
``max_bits``, then some segment starts a chain along the ring whose first l
segments together differ in at most ``l * max_bits / segments`` bits, for
every l.  The l with a budget below one bit must match exactly and serve as
the join key; the longer chains are checked on each candidate, shortest first,
before the full Hamming distance.

Only different fingerprints are compared: copies meet in a map-side
aggregation and are never paired.  A key that more than ``bucket`` different
fingerprints share is answered without pairs: two fingerprints are at most two
bits apart exactly if the balls of radius one around them meet, so each
fingerprint of such a key is listed under the 65 members of its ball, and what
shares a member (65 at most) is linked to the smallest there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, keyed, unused, written
from quillspark.llm.components import components

BITS = 64
CHUNK = 1 << 15


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of a whole text; 0 without words.

    A-Z are lower-cased, words lie between ASCII white space, shingles repeat
    as often as they occur, and a bit is set if over half of the XXH64 values
    (seed 42) have it.
    """
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else iter([b" ".join(found)])
    n = max(1, len(found) - words + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, [42] * n), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        ones += np.unpackbits(h[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp long)``, one row per row; a null text is an empty one."""

    def rows(batch):
        out = [signed(fingerprint(t, words)) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(out, pa.int64())}

    src = keyed(df, doc_id=id_col, text=text_col)
    return arrow_map(src, rows, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def ring(segments: int, max_bits: int) -> tuple[list[tuple[int, int]], int]:
    """(first bit, width) of each segment, and how many must match in a row."""
    cuts = [BITS * i // segments for i in range(segments + 1)]
    exact = sum(1 for n in range(1, segments + 1) if n * max_bits < segments)
    if not exact:
        raise ValueError("more segments than max_bits are needed")
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)], exact


def chain_masks(segments: int, max_bits: int) -> list[list[tuple[int, int]]]:
    """For each start: (bit mask of the first l segments, bits allowed in it)."""
    cut, _ = ring(segments, max_bits)
    out = []
    for start in range(segments):
        mask, chains = 0, []
        for n in range(segments):
            at, width = cut[(start + n) % segments]
            mask |= ((1 << width) - 1) << at
            chains.append((signed(mask), (n + 1) * max_bits // segments))
        out.append(chains)
    return out


def links(prints: DataFrame, max_bits: int = 2, segments: int = 5, bucket: int = 64) -> DataFrame:
    """``(a, b)`` links between different fingerprints of ``prints (fp)``.

    Linked ones are at most ``max_bits`` apart, and whatever is that close is
    linked directly or, under a key with over ``bucket`` fingerprints, through
    others that close.  ``prints`` must be distinct and written.
    """
    if max_bits != 2:
        raise ValueError("the exact way for crowded keys is made for 2 bits")
    _, exact = ring(segments, max_bits)
    chains = chain_masks(segments, max_bits)
    keys = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(c[exact - 1][0])) for c in chains])).alias("start", "key"))
    shared = written(keys.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    few = keys.join(shared.where(F.col("n") <= bucket).select("start", "key"), ["start", "key"]).groupBy("start", "key").agg(F.collect_list("fp").alias("fps"))
    pairs = few.select("start", "fps", F.explode("fps").alias("a")).select("start", "a", F.explode("fps").alias("b")).where("a < b")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    ok = F.lit(False)
    for start, steps in enumerate(chains):
        fits = F.col("start") == start
        for mask, allowed in steps[exact:]:
            fits = fits & (F.bit_count(apart.bitwiseAND(F.lit(mask))) <= allowed)
        ok = ok | fits
    near = pairs.where(ok).where(F.bit_count(apart) <= max_bits).select("a", "b")

    crowded = written(keys.join(shared.where(F.col("n") > bucket).select("start", "key"), ["start", "key"]).select("fp").distinct(), "crowded")
    flips = [0, *(signed(1 << i) for i in range(BITS))]
    ball = crowded.select("fp", F.explode(F.array(*[F.lit(x) for x in flips])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("center"))
    met = ball.groupBy("center").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return near.union(met).distinct()


def near_duplicates(df: DataFrame, max_bits: int = 2, segments: int = 5, bucket: int = 64, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp long, component_id)``: one row per row of ``df``.

    ``component_id`` is the smallest id that can be reached over links of at
    most ``max_bits`` differing bits.  Texts without words have fingerprint 0
    and are linked like any other.  A row with a null id takes part in links
    but never names a component, unless all of its component is null.
    Repeated rows share a component; an empty table has an empty result.
    """
    prints = written(fingerprints(df, words, id_col, text_col), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(distinct.select("fp"), max_bits, segments, bucket))
    rooted = written(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    names = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    classes = written(rooted.join(names, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


# ---- by similarity ----

SHINGLE = 5
SKETCH = 2048  # coordinates that shingles are dealt over before the projection
SEGMENT_BITS = 19
SEGMENTS = 96
AHEAD = 32  # bits after the segment, by which most chance meetings end at once
FEW = 6  # members of a key that are all compared with each other at first
NEAREST = 4  # leaders near to a later member, the first ones, of which it meets the nearest
TILE = 512  # members of a group that meet those of another tile at once, and the most that lead a key
COPIES = 64  # tiles of a group at most, by members: larger groups have larger tiles, so that rows grow with members
HELD = 1 << 20  # shingles of a tile, about: tiles of long texts are smaller
FIRST = 32  # segments whose candidates make the groups
LOOSE = 0.25  # estimated similarity of candidates that come into one group; chance makes 0.1 at most
DOUBT = 0.07  # estimates this close to the limit are settled by the shingles themselves
SMALL = 50  # shingles; estimates of texts with fewer are always settled by the shingles


def planes(seed: int = 11) -> np.ndarray:
    """Random planes, one column for each bit of a wide fingerprint.

    Normal numbers make every bit a fair measure of the angle; sums of signs
    would be zero for many texts of few shingles.
    """
    return np.random.default_rng(seed).standard_normal((SKETCH, SEGMENTS * SEGMENT_BITS), np.float32)


def shingle_hashes(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """Different shingles of a whole text by their hashes; the words alone if there are fewer."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else iter([b" ".join(found)])
    n = max(1, len(found) - words + 1)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, [42] * n), np.uint64, n))


def wide_prints(texts: list[str | None], signs: np.ndarray, step: int = 256) -> tuple[list[bytes], list[int], list[int]]:
    """Wide fingerprints of whole texts, the number of different shingles, and a hash of all of them.

    A shingle adds a sign to one coordinate of a sketch, and each bit says on
    which side of a random plane the sketch lies.
    """
    out, sizes, sets = [], [], []
    for i in range(0, len(texts), step):
        hashes = [shingle_hashes(t) for t in texts[i : i + step]]
        sets += [xxhash.xxh64_intdigest(h.tobytes()) for h in hashes]
        n = [len(h) for h in hashes]
        h = np.concatenate(hashes)
        at = np.repeat(np.arange(len(n)), n) * SKETCH + (h % np.uint64(SKETCH)).astype(np.int64)
        sign = ((h >> np.uint64(63)).astype(np.float32) * 2) - 1
        sketch = np.bincount(at, sign, len(n) * SKETCH).reshape(len(n), SKETCH).astype(np.float32)
        out += [row.tobytes() for row in np.packbits(sketch @ signs > 0, axis=1, bitorder="little")]
        sizes += n
    return out, sizes, sets


def likeness(differing: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity that so many differing bits stand for."""
    cosine = np.cos(np.pi * differing / (SEGMENTS * SEGMENT_BITS))
    shared = cosine * np.sqrt(n * m)
    return shared / np.maximum(n + m - shared, 1e-9)


def chained(a: np.ndarray, b: np.ndarray, start: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Pigeonring test of fingerprints (rows of bytes) from a shared segment on.

    Differences of the first l segments from ``start`` on are held against the
    proportional budget, l times that of a segment, for l of 4, 16 and 48; what
    passes goes on to the full distance.  The shared segment is only one of the
    starts that the pigeonring principle allows, so four deviations of such a
    sum are granted on top of the budget.
    """
    whole = SEGMENTS * SEGMENT_BITS // 8
    ok = np.ones(len(a), bool)
    for n in (4, 16, 48):
        rows, size = np.flatnonzero(ok), n * SEGMENT_BITS // 8
        at = (start[rows, None] * SEGMENT_BITS // 8 + np.arange(size)) % whole
        diff = np.bitwise_count(np.take_along_axis(a[rows], at, 1) ^ np.take_along_axis(b[rows], at, 1)).sum(1, dtype=np.int64)
        share = allowed[rows] / (8 * whole)
        ok[rows] = diff <= 8 * size * share + 4 * np.sqrt(8 * size * share * (1 - share))
    return ok


def segment_keys(fps: np.ndarray, segments: range) -> np.ndarray:
    """``number, segment, bits ahead`` of these segments of fingerprints in one long each."""
    out = np.empty((len(fps), len(segments)), np.int64)
    for i in range(0, len(fps), 512):  # bits take much room as numbers
        bits = np.unpackbits(fps[i : i + 512], axis=1, bitorder="little").reshape(-1, SEGMENTS, SEGMENT_BITS)
        seg = bits.astype(np.int64) @ (1 << np.arange(SEGMENT_BITS, dtype=np.int64))
        ahead = np.roll(seg, -1, 1) | (np.roll(seg, -2, 1) & ((1 << (AHEAD - SEGMENT_BITS)) - 1)) << SEGMENT_BITS
        out[i : i + 512] = ((np.arange(SEGMENTS) << SEGMENT_BITS | seg) << AHEAD | ahead)[:, segments.start : segments.stop]
    return out


class _Key:
    """The members of one key that later ones are compared with.

    The first ``FEW`` are compared with each other and lead; a later member is
    compared with the nearest of the first leaders near to it in the bits ahead,
    and leads itself if none is near, up to ``TILE`` leaders.  Members come in
    the same order under every key, so the first leaders of different keys are
    often the same, and pairs few.  Members of one group needn't be compared.
    Unless ``hand`` is off, the key is open once a near pair of different groups
    is passed over that way, or could be with more members than ``TILE``: its
    members, earlier ones included, are handed on, and all of them meet
    elsewhere.  So the work on a member is bounded however many there are.
    """

    def __init__(self, key: int, hand: bool = True):
        self.key, self.n, self.lead, self.kept, self.open, self.held = key, 0, 0, 0, not hand, []
        self.hand = hand
        self.leaders, self.seen = (np.zeros((3, TILE), np.int64) for _ in range(2))  # cls, group, bits ahead

    def pairs(self, cls: np.ndarray, grp: np.ndarray, ahead: np.ndarray, limit: int) -> tuple[list[tuple[int, int]], list[int]]:
        """``(cls, cls)`` to compare, and members to hand on."""
        out, members = [], []
        for c, g, x in zip(cls.tolist(), grp.tolist(), ahead.tolist(), strict=True):
            who, groups, bits = self.leaders[:, : self.lead]
            apart = np.bitwise_count(bits ^ x)
            near = np.flatnonzero(apart <= limit)
            chosen = near
            if self.n >= FEW and len(near):
                first = near[:NEAREST]
                chosen = first[[apart[first].argmin()]]
            chosen = chosen[groups[chosen] != g]
            out += [(int(who[i]), c) for i in chosen]
            if not self.open:
                _, groups, bits = self.seen[:, : self.kept]
                other = groups != g
                met = (np.bitwise_count(bits ^ x) <= limit) & other
                if met.sum() > len(chosen) or (self.kept == TILE and other.any()):
                    self.open, members, self.held = True, members + self.held, []
                else:  # beyond TILE all are of one group
                    if self.kept < TILE:
                        self.seen[:, self.kept] = c, g, x
                        self.kept += 1
                    self.held.append(c)
            if self.open and self.hand:
                members.append(c)
            if self.lead < TILE and (self.n < FEW or not len(near)):
                self.leaders[:, self.lead] = c, g, x
                self.lead += 1
            self.n += 1
        return out, members


COMPARED = "a long, b long, start int, members binary"


def _compared(batches, limit: int, hand: bool):
    """Pairs of members of each key from different groups, from rows sorted by key.

    A row's key has the segment, and below it the bits after it on the ring; a
    pair may differ there in ``limit`` bits.  Small keys are met as arrays,
    others and those at a batch's ends by :class:`_Key`.  Members of an open
    key come together, in a row with the key as ``a``.
    """
    low, now = (1 << AHEAD) - 1, _Key(-1, hand)
    for batch in batches:
        packed, cls, grp = (batch.column(c).to_numpy() for c in ("key", "cls", "grp"))
        if not len(packed):
            continue
        key, ahead = packed >> AHEAD, packed & low
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        single = sizes <= FEW
        single[[0, -1]] = False
        small = np.flatnonzero(single & (sizes > 1))
        pairs, members = [np.zeros((0, 3), np.int64)], {}
        for i in range(FEW):
            for j in range(i):
                at = starts[small[sizes[small] > i]]
                x, y = at + j, at + i
                near = (np.bitwise_count(ahead[y] ^ ahead[x]) <= limit) & (grp[x] != grp[y])
                x, y = x[near], y[near]
                pairs.append(np.stack([cls[x], cls[y], key[x] >> SEGMENT_BITS], 1))
        for run in np.flatnonzero(~single):
            part = slice(starts[run], starts[run] + sizes[run])
            if now.key != key[part.start]:
                now = _Key(int(key[part.start]), hand)
            found, handed = now.pairs(cls[part], grp[part], ahead[part], limit)
            if found:
                pairs.append(np.array([(*f, now.key >> SEGMENT_BITS) for f in found], np.int64))
            if handed:
                members[now.key] = np.array(handed, np.int64).tobytes()
        p, n = np.concatenate(pairs), len(members)
        turned = p[:, 0] > p[:, 1]
        p[turned] = p[turned][:, [1, 0, 2]]
        b = pa.concat_arrays([pa.array(p[:, 1]), pa.nulls(n, pa.int64())])
        start = np.concatenate([p[:, 2], np.full(n, -1)]).astype(np.int32)
        held = pa.concat_arrays([pa.nulls(len(p), pa.binary()), pa.array(list(members.values()), pa.binary())])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[:, 0], np.array(list(members), np.int64)])), b, pa.array(start), held], ["a", "b", "start", "members"])


def _near(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, start: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
    """Which candidates (rows of bytes, shingle counts) may be ``low`` alike, and how similar they look."""
    cosine = np.clip(low / (1 + low) * (n + m) / np.sqrt(n * m), -1, 1)
    allowed = np.arccos(cosine) / np.pi * SEGMENTS * SEGMENT_BITS
    ok = np.flatnonzero(chained(a, b, start, allowed))
    guess = likeness(np.bitwise_count(a[ok] ^ b[ok]).sum(1, dtype=np.int64), n[ok], m[ok])
    kept = (guess >= low) | (np.minimum(n[ok], m[ok]) < SMALL)  # few shingles make a rough estimate
    return ok[kept], guess[kept]


def _runs(batches, names: tuple[str, ...]):
    """Tables of the neighbouring rows that are equal in ``names``, across batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(c).to_numpy() for c in names])
        starts = np.flatnonzero(np.concatenate([[True], (cols[:, 1:] != cols[:, :-1]).any(0)]))
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            if held and tuple(cols[:, i]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(cols[:, i])
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _tied(batches, least: float, step: int = 1 << 16):
    """``(a, b)`` links that join what is ``least`` alike within each tile, a forest of them.

    Rows are sorted by tile.  All pairs of a tile with different labels are held
    against their whole fingerprints; those that may be similar enough, and are
    not joined by then, are settled by their shingles.
    """
    low = max(0.05, least - DOUBT)
    for t in _runs(batches, ("grp", "x", "y")):
        x, y = (t.column(c)[0].as_py() for c in ("x", "y"))
        cls, label, n, part = (t.column(c).to_numpy() for c in ("cls", "label", "n", "part"))
        left, right = np.flatnonzero(part == x), np.flatnonzero(part == y)
        if not len(left) or not len(right) or (label == label[0]).all():
            continue
        fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint8).reshape(len(cls), -1)
        fps = np.pad(fps, ((0, 0), (0, -fps.shape[1] % 8))).view(np.uint64)
        own, ids = np.unique(np.frombuffer(b"".join(t.column("h").to_pylist()), np.uint64), return_inverse=True)
        marked, ids, size = np.zeros(len(own), np.int64), np.split(ids, np.cumsum(n)[:-1]), n.astype(float)
        tie, found = np.arange(len(cls)), []
        each = max(1, step // len(right))
        for i in range(0, len(left), each):
            rows = left[i : i + each]
            differing = np.bitwise_count(fps[rows, None] ^ fps[None, right]).sum(2, dtype=np.int64)
            guess = likeness(differing, size[rows, None], size[None, right])
            ok = ((guess >= low) | (np.minimum(n[rows, None], n[None, right]) < SMALL)) & (label[rows, None] != label[None, right])
            if x == y:
                ok &= rows[:, None] < right[None, :]
            for r in np.flatnonzero(ok.any(1)):
                p, q = rows[r], right[ok[r]]
                q = q[tie[q] != tie[p]]
                if not len(q):
                    continue
                marked[ids[p]] = 1
                both = np.add.reduceat(marked[np.concatenate([ids[j] for j in q])], np.cumsum(n[q]) - n[q])
                marked[ids[p]] = 0
                for j in q[both >= least * (n[p] + n[q] - both)]:
                    if tie[j] != tie[p]:
                        tie[tie == tie[j]] = tie[p]
                        found.append((cls[p], cls[j]))
        if found:
            a, b = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _tiled(members: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """:func:`_tied` of ``members (grp, cls, label, n, fp, h)``, of which ``sizes (grp, label, n)`` are some columns.

    Every pair of a group meets once.  Members are dealt over tiles by hash and
    each two tiles meet in one place, so that no group is bound to one task.
    """
    parts = F.greatest(F.least(F.ceil(F.col("size") / TILE), F.lit(COPIES)), F.ceil(F.col("total") / HELD)).cast("int")
    mixed = sizes.groupBy("grp").agg(F.count("*").alias("size"), F.sum("n").alias("total"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    mixed = written(mixed.select("grp", parts.alias("parts")), "wide-groups")
    dealt = members.join(mixed, "grp").withColumn("part", F.pmod(F.xxhash64("cls", "grp"), F.col("parts")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = tiles.select("grp", "cls", "label", "n", "fp", "h", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"))
    return tiles.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y").mapInArrow(lambda batches: _tied(batches, least), "a long, b long")


def similar(df: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``(doc_id, cls, component_id)``: texts whose five-word shingles are that similar.

    Texts with equal sets of shingles are one class.  Classes that share one of the
    96 segments of 19 bits, and are near in the 32 bits after it, are
    candidates; they pass the pigeonring test, then the full distance, from
    which the similarity is estimated.  Candidates of the first 32 segments that
    look at all alike come into one group, and all pairs of a group are met,
    wherever their segments differ.  Then candidates of different groups meet under all
    96 segments: up to six under a key are all compared, later ones with the
    nearest that leads; where that passes over a near pair of different groups,
    all pairs under the key are met as well.  So a member is moved a bounded
    number of times, and nothing is left out of what candidates are.
    Whatever the estimate leaves open the shingles decide.
    Texts with too few shingles to
    be that similar to any other set need no candidates.  At a similarity of
    0.8 a pair is a candidate with probability 0.986, at 0.85 with 0.999.
    Over some five million different texts, wider
    segments (and more of them) keep keys from filling by chance.  Nulls,
    copies and empty tables as in :func:`near_duplicates`.  ``row_col`` names a
    column that tells rows of a written table apart; else one is written.
    """
    if row_col:
        src = keyed(df, doc_id=id_col, text=text_col, row=row_col)
    else:
        src = written(keyed(df, doc_id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id()), "rows")

    def rows(batch):
        fps, n, sets = wide_prints(batch.column("text").to_pylist(), _signs())
        cls = [signed(h) for h in sets]
        return {"doc_id": batch.column("doc_id"), "row": batch.column("row"), "cls": pa.array(cls, pa.int64()), "n": pa.array(n, pa.int32()), "fp": pa.array(fps, pa.binary())}

    prints = written(arrow_map(src, rows, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, row long, cls long, n int, fp binary"), "wide-prints")
    firsts = prints.groupBy("cls").agg(F.min("row").alias("row"), F.min("doc_id").alias("first"))
    firsts = written(firsts, "wide-firsts")
    classes = written(prints.join(firsts.select("row"), "row", "left_semi").select("cls", "row", "n", "fp"), "wide-classes")

    def handed(batch):
        each = [np.frombuffer(m, np.int64) for m in batch.column("members").to_pylist()]
        return {"grp": pa.array(np.repeat(batch.column("a").to_numpy(), [len(m) for m in each])), "cls": pa.array(np.concatenate(each))}

    def shingles(batch):
        return {"cls": batch.column("cls"), "h": pa.array([shingle_hashes(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())}

    def exact(batch):
        kept = []
        for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both >= least * (len(a) + len(b) - both):
                kept.append(i)
        at = pa.array(kept, pa.int64())
        return {c: batch.column(c).take(at) for c in ("a", "b")}

    def shingled(asked):
        """``(cls, h)``: the shingles of the classes ``asked (cls)``."""
        rows = written(asked.distinct().join(classes.select("cls", "row"), "cls"), "wide-asked")
        return written(arrow_map(src.select("row", "text").join(rows, "row").select("cls", "text"), shingles, "cls long, h binary"), "wide-shingles")

    def candidates(grouped, segments, hand):
        """``(a, b, start, members)``: see :func:`_compared`, of ``grouped (cls, grp, fp)``."""

        def keys_of(batches, step=1024):
            for batch in batches:
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    fps = np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    cls, grp = (pa.array(np.repeat(part.column(c).to_numpy(), len(segments))) for c in ("cls", "grp"))
                    yield pa.RecordBatch.from_arrays([cls, grp, pa.array(segment_keys(fps, segments).ravel())], ["cls", "grp", "key"])

        keys = grouped.select("cls", "grp", "fp").mapInArrow(keys_of, "cls long, grp long, key long")
        # members of a key stand together; classes are hashes, so in a random order that is the same for all keys
        key = F.shiftright("key", AHEAD)
        dealt = keys.repartition(key).sortWithinPartitions(key, "cls").select("key", "cls", "grp")
        return written(dealt.mapInArrow(lambda batches: _compared(batches, limit, hand), COMPARED), "wide-met-keys")

    def close(met, low):
        """``(a, b, guess)``: the pairs of ``met`` that may be ``low`` alike."""

        def near(batch):
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
            n, m = (batch.column(c).to_numpy().astype(float) for c in ("n", "m"))
            ok, guess = _near(a, b, n, m, batch.column("start").to_numpy(), low)
            return {c: batch.column(c).take(pa.array(ok)) for c in ("a", "b")} | {"guess": pa.array(guess)}

        pairs = met.where("members is null").groupBy("a", "b").agg(F.min("start").alias("start"))
        left = classes.select(F.col("cls").alias("a"), F.col("n").alias("n"), F.col("fp").alias("x"))
        right = classes.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("fp").alias("y"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "start", "n", "m", "x", "y")
        return arrow_map(both, near, "a long, b long, guess double")

    fewest = max(1, math.ceil(least / (1 - least) - 1e-9)) if least < 1 else math.inf  # n of n + 1 shingles
    share = np.arccos(2 * least / (1 + least)) / np.pi
    limit = int(AHEAD * share + 2.5 * np.sqrt(AHEAD * share * (1 - share)))
    known = classes.where(F.col("n") >= float(fewest))

    # groups of what looks at all alike, in which all pairs meet
    met = candidates(known.withColumn("grp", F.col("cls")), range(FIRST), False)
    loose = min(LOOSE, least)
    groups = components(close(met, loose).where(F.col("guess") >= loose).select("a", "b")).select(F.col("node").alias("cls"), F.col("root").alias("grp"))
    within = groups.withColumn("label", F.col("cls")).join(classes.select("cls", "n", "fp"), "cls")
    links = written(_tiled(within.join(shingled(groups.select("cls")), "cls"), within, least), "wide-links")

    # candidates of different groups, and the members of keys where some were passed over
    grouped = written(known.join(groups, "cls", "left").withColumn("grp", F.coalesce("grp", "cls")), "wide-grouped")
    met = candidates(grouped, range(SEGMENTS), True)
    pairs = written(close(met, max(0.05, least - DOUBT)), "wide-close")
    members = written(arrow_map(met.where("members is not null").select("a", "members"), handed, "grp long, cls long"), "wide-members")
    held = shingled(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(members.select("cls")))
    doubtful = pairs.join(held.select(F.col("cls").alias("a"), F.col("h").alias("x")), "a").join(held.select(F.col("cls").alias("b"), F.col("h").alias("y")), "b")
    links = links.union(arrow_map(doubtful.select("a", "b", "x", "y"), exact, "a long, b long"))
    if not members.isEmpty():
        across = members.join(grouped.select("cls", F.col("grp").alias("label"), "n", "fp"), "cls")
        links = links.union(_tiled(across.join(held, "cls"), across, least))

    found = components(links)
    rooted = written(firsts.join(found, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("root", "cls").alias("root")), "wide-rooted")
    names = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "wide-names")
    named = written(rooted.join(names, "root").select("cls", "component_id"), "wide-named")
    return prints.select("doc_id", "cls").join(named, "cls", "left").select("doc_id", "cls", "component_id")


_SIGNS: list[np.ndarray] = []


def _signs() -> np.ndarray:
    if not _SIGNS:
        _SIGNS.append(planes())
    return _SIGNS[0]


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float | None = 0.8, **options) -> DataFrame:
    """The rows of ``df`` that stay: of each component one row with its smallest id.

    Components are those of :func:`similar` at ``least``, or with None those of
    :func:`near_duplicates` with ``options``.  Columns are those of ``df``.
    Among rows that repeat that id, the first one written stays; a component
    whose ids are all null keeps one row.
    """
    row = unused(df, "row")
    whole = written(df.withColumn(row, F.monotonically_increasing_id()), "whole")
    keyed_rows = whole.select(F.struct(F.col(f"`{id_col}`").isNull().alias("no"), F.col(f"`{id_col}`").alias("id"), F.col(row).alias("row")).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = near_duplicates(keyed_rows, **options) if least is None else similar(keyed_rows.withColumn("row", F.col("doc_id.row")), least, row_col="row")
    kept = written(found.groupBy("component_id").agg(F.lit(1).alias("one")).select(F.col("component_id.row").alias(row)), "kept")
    # the same plan at every size: ids and rows meet sorted, whatever fits where
    return whole.join(kept.hint("merge"), row, "left_semi").drop(row)
