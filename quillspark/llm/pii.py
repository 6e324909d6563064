"""Personal data: exact patterns, and a character BiLSTM-CRF that adds to them.

The tagger reads one character at a time in both directions and scores
begin/inside tags of four kinds; a CRF with learned transitions decodes each
window.  It is trained in numpy from generated text with labelled spans, the
same for every corpus; ``python -m quillspark.llm.pii`` trains it and writes the
weights beside this file, from where the driver takes them.

Every kind needs a digit or an ``@``: what a window's decoding yields without
one is no piece of a span and goes before pieces are reconciled.  A window
that holds neither can yield nothing else, and is not decoded.
Windows overlap by half.  Spans cut by a window's edge are merged with the
neighbour's, then the best-scoring set of spans that don't overlap is chosen
over the whole text.
"""

from __future__ import annotations

import bisect
import random
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_map, keyed, texts

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
WINDOW, STRIDE = 96, 48
HIDDEN = 16
TRIGGER = re.compile("[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Pattern matches, by kind as listed, then start; each kind in linear time."""
    if not TRIGGER.search(text):
        return []
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in DOTTED.finditer(text):  # a run of parts holds a match for every four
        if m[0].count(".") >= 3:
            start, parts = m.start(), m[0].split(".")
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                width = sum(map(len, four)) + 3
                if all(map(_small, four)):
                    out.append(("ip", start, start + width))
                start += width + 1
    for m in CARD.finditer(text):
        digits = NO_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return out


# ---- characters ----

SINGLE = "abcdefghijklmnopqrstuvwxyz@.-+() \n_%,:;/#\"'=[]|"
PAD, DIGIT, UPPER, LETTER, OTHER = range(5)
CODES = 5 + len(SINGLE)


@lru_cache(1)
def _codes() -> np.ndarray:
    out = np.full(0x250, LETTER, np.uint8)
    out[:0xC0] = OTHER
    for i in range(0x250):
        c = chr(i)
        if c in SINGLE:
            out[i] = 5 + SINGLE.index(c)
        elif "0" <= c <= "9":
            out[i] = DIGIT
        elif "A" <= c <= "Z":
            out[i] = UPPER
    return out


def coded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _codes()[np.minimum(points, 0x24F)]


# ---- labelled training text ----


def labelled(n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """``n`` windows of generated text and their tags, from known spans."""
    rng = random.Random(int(rng.integers(1 << 62)))
    pick = rng.choice
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    syllables = ["an", "er", "the", "on", "re", "ti", "és", "ou", "ñi", "ch", "ung", "la", "de", "be", "ver", "ción", "au", "ß", "st"]

    def word() -> str:
        w = "".join(pick(syllables) for _ in range(rng.randrange(1, 5)))
        return (w.capitalize() if rng.random() < 0.15 else w) + (pick([",", ".", "***", "&&&", "!!"]) if rng.random() < 0.15 else "")

    def email() -> str:
        name = pick(["{}.{}", "{}{}", "{}_{}", "{}-{}"]).format(pick(syllables) + pick(["an", "en", "o"]), digits(rng.randrange(3)) or "x")
        host = f"{pick(['mail', 'post', 'web'])}{digits(rng.randrange(2))}{pick(['.example', '', '.corp'])}.{pick(['com', 'org', 'net', 'de', 'fr'])}"
        return name + pick(["@", "@", "@", "@", " @ ", "(@)", "[@]"]) + host

    def ip() -> str:
        return ".".join(str(rng.randrange(256)) for _ in range(4))

    def card() -> str:
        return pick(["", "", " ", "-", "."]).join([digits(4) for _ in range(4)])

    def phone() -> str:
        shape = pick(["+1 ({}) {}-{}", "+{0} {1} {2}", "({}) {}-{}", "{}-{}-{}", "+49 {} {}{}", "{}.{}.{}", "00{} {} {}"])
        return shape.format(digits(3), digits(3), digits(4))

    def noise() -> str:
        hexa = "".join(pick("0123456789abcdef") for _ in range(rng.randrange(12, 41)))
        return pick([f'token = "{hexa}"', f"{digits(4)}", f"{digits(1)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", f"version {digits(1)}.", f"{digits(7)}", f"{digits(2)}%", f"#{digits(5)}", f"$ {digits(3)}.{digits(2)}", f"v{digits(1)}.{digits(2)}.{digits(1)}", "@ " + word(), f"p. {digits(2)}-{digits(2)}"])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    x, y = np.zeros((n, WINDOW), np.uint8), np.zeros((n, WINDOW), np.int64)
    for r in range(n):
        text, tags = "", []
        while len(text) < WINDOW:
            roll = rng.random()
            if roll < 0.22:
                kind = rng.randrange(len(KINDS))
                piece = makers[KINDS[kind]]()
                tags += [1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1)
            else:
                piece = noise() if roll < 0.4 else word()
                tags += [0] * len(piece)
            gap = pick([" ", " ", " ", "\n", ", "])
            text, tags = text + piece + gap, tags + [0] * len(gap)
        cut = rng.randrange(max(1, len(text) - WINDOW + 1))
        x[r], y[r] = coded(text[cut : cut + WINDOW]), tags[cut : cut + WINDOW]
    return x, y


# ---- the tagger ----


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Weights of the BiLSTM and the CRF, and what is computed with them."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        h = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (CODES, 4 * h)).astype(np.float32)
            self.p[f"x{d}"][:, h : 2 * h] += 1  # gates that forget start open
            self.p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h)).astype(np.float32)
        self.p["out"] = rng.normal(0, 0.3, (2 * h, TAGS)).astype(np.float32)
        self.p["bias"] = np.zeros(TAGS, np.float32)
        self.p["trans"] = np.zeros((TAGS, TAGS), np.float32)
        self.p["start"] = np.zeros(TAGS, np.float32)
        self.hidden = h
        to_inside = np.arange(TAGS)
        self.banned = np.zeros((TAGS, TAGS), np.float32)  # an inside tag follows its own kind only
        for j in range(2, TAGS, 2):
            self.banned[:, j] = np.where((to_inside == j) | (to_inside == j - 1), 0, -1e4)

    def _run(self, x: np.ndarray, d: str, keep: bool = False):
        """Hidden states (T, N, H) in text order, and what backward needs."""
        p, h, (n, t) = self.p, self.hidden, x.shape
        table, recur = p[f"x{d}"], p[f"h{d}"]
        s, c = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        states, saved = np.empty((t, n, h), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            z = table[x[:, k]] + s @ recur
            gates, g = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            new = f * c + i * g
            tc = np.tanh(new)
            if keep:
                saved.append((k, s, c, i, f, o, g, tc))
            s, c = o * tc, new
            states[k] = s
        return states, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (T, N, TAGS)."""
        both = np.concatenate([self._run(x, "f")[0], self._run(x, "b")[0]], 2)
        return both @ self.p["out"] + self.p["bias"]

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags (N, T) under emissions (T, N, TAGS)."""
        t, n, _ = e.shape
        move = self.p["trans"] + self.banned
        score, back = e[0] + self.p["start"], np.empty((t, n, TAGS), np.int8)
        for k in range(1, t):
            ways = score[:, :, None] + move
            back[k] = ways.argmax(1)
            score = ways.max(1) + e[k]
        out = np.empty((n, t), np.int8)
        out[:, -1] = score.argmax(1)
        for k in range(t - 1, 0, -1):
            out[:, k - 1] = np.take_along_axis(back[k], out[:, k : k + 1].astype(np.int64), 1)[:, 0]
        return out

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradients."""
        p, h, (n, t) = self.p, self.hidden, x.shape
        runs = {d: self._run(x, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        e = both @ p["out"] + p["bias"]
        move = p["trans"] + self.banned
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        lse = lambda a, axis: (m := a.max(axis)) + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis))
        alpha[0] = e[0] + p["start"]
        for k in range(1, t):
            alpha[k] = lse(alpha[k - 1][:, :, None] + move, 1) + e[k]
        for k in range(t - 2, -1, -1):
            beta[k] = lse(move + (e[k + 1] + beta[k + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        gold = np.take_along_axis(e, y.T[:, :, None], 2).sum((0, 2)) + p["start"][y[:, 0]] + move[y[:, :-1], y[:, 1:]].sum(1)
        de = np.exp(alpha + beta - z[:, None])
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["start"] = de[0].sum(0)
        for k in range(1, t):
            g["trans"] += np.exp(alpha[k - 1][:, :, None] + move + (e[k] + beta[k])[:, None, :] - z[:, None, None]).sum(0)
        np.add.at(g["trans"], (y[:, :-1], y[:, 1:]), -1)
        np.add.at(g["start"], y[:, 0], -1)
        np.put_along_axis(de, y.T[:, :, None], np.take_along_axis(de, y.T[:, :, None], 2) - 1, 2)
        g["out"], g["bias"] = np.einsum("tnh,tnk->hk", both, de, optimize=True), de.sum((0, 1))
        dboth = de @ p["out"].T
        seen = np.eye(CODES, dtype=np.float32)[x.T.ravel()]  # which character each row of the gradients belongs to
        for d, part in (("f", dboth[:, :, :h]), ("b", dboth[:, :, h:])):
            recur = p[f"h{d}"]
            ds, dc, all_dz = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((t, n, 4 * h), dboth.dtype)
            for k, s0, c0, i, f, o, gg, tc in reversed(runs[d][1]):
                ds = ds + part[k]
                dc = dc + ds * o * (1 - tc * tc)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), ds * tc * o * (1 - o), dc * i * (1 - gg * gg)], 1)
                all_dz[k] = dz
                g[f"h{d}"] += s0.T @ dz
                ds, dc = dz @ recur.T, dc * f
            g[f"x{d}"] += seen.T @ all_dz.reshape(n * t, -1)
        return float((z - gold).mean()), {k: v / n for k, v in g.items()}


WEIGHTS = Path(__file__).with_suffix(".npz")


@lru_cache(1)
def trained() -> Tagger:
    """The tagger whose weights lie beside this file; trained anew if they don't."""
    if not WEIGHTS.exists():
        return train()
    tagger = Tagger()
    with np.load(WEIGHTS) as held:
        tagger.p = {k: held[k] for k in tagger.p}
    return tagger


def train(windows: int = 2400, epochs: int = 6, batch: int = 80, seed: int = 7) -> Tagger:
    """A tagger trained by Adam on ``windows`` labelled windows; seeded."""
    rng = np.random.default_rng(seed)
    x, y = labelled(windows, rng)
    tagger = Tagger(seed)
    m = {k: np.zeros_like(v) for k, v in tagger.p.items()}
    v = {k: np.zeros_like(w) for k, w in tagger.p.items()}
    done, total = 0, epochs * (windows // batch)
    for _ in range(epochs):
        order = rng.permutation(windows)
        for i in range(0, windows - batch + 1, batch):
            rows = order[i : i + batch]
            _, grad = tagger.step(x[rows], y[rows])
            done += 1
            rate = 0.02 * (1 - 0.9 * done / total)
            norm = np.sqrt(sum(float((a * a).sum()) for a in grad.values()))
            for k, a in grad.items():
                a = a * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                tagger.p[k] -= (rate * (m[k] / (1 - 0.9**done)) / (np.sqrt(v[k] / (1 - 0.99**done)) + 1e-8)).astype(np.float32)
    return tagger


# ---- spans of whole texts ----


def _valid(kind: str, piece: str) -> bool:
    """What any span of the kind must hold, however it is spelled."""
    digits = NO_DIGIT.sub("", piece)
    if kind == "email":
        return "@" in piece and "." in piece.partition("@")[2] and len(piece) >= 6 and "\n" not in piece
    if kind == "ip":
        parts = piece.split(".")
        return len(parts) == 4 and all(p.isdigit() and _small(p) for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 .-]", piece)
    return 9 <= len(digits) <= 15 and not re.search(r"[^0-9 ().+-]", piece) and bool(re.search(r"[^0-9]", piece))


def reconciled(pieces: list[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, int]]:
    """The best set of spans over a whole text.

    ``pieces`` are ``(kind, start, end, score, cut_left, cut_right)`` of all
    windows.  What is cut by an edge is united with what it overlaps of its
    kind; among the rest, weighted interval scheduling takes the set with the
    highest total score.  Equal scores go to the set that ends first.
    """
    merged: list[list] = []
    for kind, start, end, score, left, right in sorted(pieces):
        last = merged[-1] if merged else None
        if last and last[0] == kind and start <= last[2] and (left or last[5]):
            if end > last[2] or (end == last[2] and not right):
                last[2], last[5] = max(end, last[2]), right
            last[3] = max(last[3], score)
        else:
            merged.append([kind, start, end, score, left, right])
    spans = sorted((e, s, k, w) for k, s, e, w, _, _ in merged if w > 0)
    ends = [x[0] for x in spans]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    for i, (_, start, _, weight) in enumerate(spans):
        j = bisect.bisect_right(ends, start, 0, i)
        with_it = best[j][0] + weight
        best.append((with_it, j, True) if with_it > best[i][0] else (best[i][0], i, False))
    out, i = [], len(spans)
    while i:
        _, j, taken = best[i]
        if taken:
            e, s, k, _ = spans[i - 1]
            out.append((k, s, e))
        i = j
    return out[::-1]


def model_spans(tagger: Tagger, batch: list[str], chunk: int = 512, every: bool = False) -> list[list[tuple[str, int, int]]]:
    """What the tagger finds in each whole text.

    ``every`` decodes windows without a digit or ``@`` too, to the same end.
    """
    at: list[tuple[int, int]] = []
    codes = {}
    for d, text in enumerate(batch):
        if TRIGGER.search(text) or (every and text):
            c = codes[d] = coded(text)
            hot = np.flatnonzero((c == DIGIT) | (c == 5 + SINGLE.index("@")) | every)
            k = hot // STRIDE
            for w in np.unique(np.concatenate([k, k[k > 0] - 1])):
                at.append((d, int(w) * STRIDE))
    pieces: dict[int, list] = {d: [] for d in codes}
    for i in range(0, len(at), chunk):
        part = at[i : i + chunk]
        x = np.zeros((len(part), WINDOW), np.uint8)
        for r, (d, s) in enumerate(part):
            window = codes[d][s : s + WINDOW]
            x[r, : len(window)] = window
        e = tagger.emissions(x)
        tags = tagger.viterbi(e)
        for r in np.flatnonzero(tags.any(1)):
            d, s = part[r]
            row, size, k = tags[r], min(WINDOW, len(codes[d]) - s), 0
            while k < size:
                tag = int(row[k])
                if not tag:
                    k += 1
                    continue
                kind, j = (tag - 1) // 2, k + 1
                while j < size and row[j] == 2 + 2 * kind:
                    j += 1
                if not TRIGGER.search(batch[d], s + k, s + j):
                    k = j
                    continue
                gain = float((e[k:j, r].take([1 + 2 * kind, 2 + 2 * kind], 1).max(1) - e[k:j, r, 0]).sum())
                pieces[d].append((kind, s + k, s + j, gain, k == 0 and s > 0, j == size and s + size < len(codes[d])))
                k = j
    out = [[] for _ in batch]
    for d, found in pieces.items():
        out[d] = [(KINDS[k], s, e) for k, s, e in reconciled(found) if _valid(KINDS[k], batch[d][s:e])]
    return out


def all_spans(tagger: Tagger, batch: list[str]) -> list[tuple[list, list]]:
    """``(base, base and added)`` of each text, by kind as listed, then start."""
    out = []
    for text, more in zip(batch, model_spans(tagger, batch), strict=True):
        base = base_spans(text)
        added = [m for m in more if not any(s < m[2] and m[1] < e for _, s, e in base)]
        out.append((base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))))
    return out


def spans_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, overlapping ones as one, replaced by its kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(df: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans)``: pattern spans, and those with the tagger's added.

    Both are arrays of ``(kind, start, end)`` in code points, by kind as
    listed, then start.  A row per row, repeated ones and ones with a null id
    included; a null text is an empty one; texts are read whole whatever their
    length; further columns, however named, play no part.  An empty table has
    an empty result.
    """
    tagger = tagger or trained()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]

    def rows(batch):
        found = all_spans(tagger, texts(batch))
        return {"doc_id": batch.column("doc_id"), "base": pa.array([as_rows(b) for b, _ in found], kind), "spans": pa.array([as_rows(s) for _, s in found], kind)}

    src = keyed(df, doc_id=id_col, text=text_col)
    spans = "array<struct<kind:string,start:int,end:int>>"
    return arrow_map(src, rows, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, base {spans}, spans {spans}")


def redact(df: DataFrame, tagger: Tagger | None = None, text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``df`` with every span in its text replaced by its kind in brackets.

    Columns and rows stay as they are; null texts stay null.  ``size_col``, if
    there is such a column, is set to the new length.
    """
    tagger = tagger or trained()

    def clean(batches):
        for batch in batches:
            found = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            spans = all_spans(tagger, [t or "" for t in found])
            new = pa.array([t and redacted(t, s) for t, (_, s) in zip(found, spans, strict=True)], pa.string())
            yield batch.set_column(batch.schema.get_field_index(text_col), text_col, new)

    out = df.mapInArrow(clean, df.schema)
    if size_col and size_col in df.columns:
        out = out.withColumn(size_col, F.when(F.col(text_col).isNotNull(), F.length(text_col)).otherwise(F.col(size_col)).cast(df.schema[size_col].dataType))
    return out


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **train().p)
