"""Byte-level BPE encoding and decoding with a segment tree per piece.

A piece's adjacent pairs are the leaves of a tree with 16 children to a node;
every node holds the smallest ``rank * 2**32 + position`` beneath it, so that
the root is the leftmost of the lowest-ranked merges.  A merge changes three
leaves and the nodes above them, in logarithmic time, until the root says that
nothing can be merged.  Pieces of all lengths go the same way.

The vocabulary is a JSON file of the ``tokenizers`` format (byte-level BPE).
Its path is a parameter; executors read the file where it is installed.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillspark.llm.common import arrow_map, keyed, texts

#: Fixed by the vocabulary's pre-tokenizer: the pieces that are merged within.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same pieces where all letters are Latin ones up to U+024F, for the faster
#: matcher; a text with any character that ``PLAIN`` doesn't name takes the other.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
LATIN_PIECES = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+"""
PLAIN = "\x00-\x1b\x20-\x7fÀ-ɏ‐-‧"
NONE = 1 << 62
PLACE = (1 << 32) - 1
CHILDREN = 16
#: Pieces that a Python worker keeps encoded; when full, it starts afresh.
CACHED_PIECES = 300_000
SHORT = 64


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in order.
    """
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class Codec:
    """Encodes and decodes whole texts with the vocabulary at ``path``."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        pre = spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.first = [vocab.get(c, -1) for c in letters]
        self.bytes_of = {i: bytes(back[c] for c in word) for word, i in vocab.items()}
        self.name_of = {i: str(i) for i in vocab.values()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[a], vocab[b]] = (rank << 32, vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        for content, i in self.added.items():
            self.bytes_of[i], self.name_of[i] = content.encode(), str(i)
        self.split_added = regex.compile("(" + "|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pieces, self.latin_pieces, self.odd = regex.compile(PIECES), re.compile(LATIN_PIECES), re.compile(f"[^{PLAIN}]")
        self.cache: dict[str, list[int]] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """The ids of one piece after all merges, through the segment tree."""
        n = len(ids)
        if n < 2:
            return ids
        merge, find, ids = self.merge, self.merge.get, list(ids)
        levels = [[m[0] | i if m else NONE for i, m in enumerate(map(find, zip(ids, ids[1:], strict=False)))]]
        while len(levels) < 2 or len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([min(below[k : k + CHILDREN]) for k in range(0, len(below), CHILDREN)])
        leaves, nodes, top = levels[0], levels[1:], levels[-1]
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (root := top[0]) != NONE:
            i = root & PLACE
            j = following[i]  # what i is merged with; k and h are the neighbours of the new symbol
            k, h = following[j], before[i]
            new = ids[i] = merge[ids[i], ids[j]][1]
            ids[j], following[i] = -1, k
            if j < n - 1:
                leaves[j] = NONE
            if k < n:
                before[k] = i
                m = find((new, ids[k]))
                leaves[i] = m[0] | i if m else NONE
            else:
                leaves[i] = NONE
            if h >= 0:
                m = find((ids[h], new))
                leaves[h] = m[0] | h if m else NONE
            below, lo, hi = leaves, (h if h >= 0 else i) // CHILDREN, min(j, n - 2) // CHILDREN
            for level in nodes:  # the nodes above the leaves h, i and j, level by level
                for c in {lo, i // CHILDREN, hi} if lo != hi else (lo,):
                    level[c] = min(below[c * CHILDREN : c * CHILDREN + CHILDREN])
                below, lo, i, hi = level, lo // CHILDREN, i // CHILDREN, hi // CHILDREN
        return [x for x in ids if x >= 0]

    def piece(self, piece: str) -> list[int]:
        """The ids of one piece, remembered if it is short."""
        first = self.first
        ids = self.merged([x for b in piece.encode("utf-8", "replace") if (x := first[b]) >= 0])
        if len(piece) <= SHORT:
            if len(self.cache) >= CACHED_PIECES:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text, added tokens included."""
        out: list[int] = []
        get, piece, more = self.cache.get, self.piece, out.extend
        pieces = self.pieces if self.odd.search(text) else self.latin_pieces
        for k, span in enumerate(self.split_added.split(text) if self.split_added else [text]):
            if k % 2:
                out.append(self.added[span])
            elif span:
                for p in pieces.findall(span):
                    more(get(p) or piece(p))
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes of all ids together as UTF-8; what isn't UTF-8 becomes U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode()


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` of every whole text.

    A null or empty text has no ids.  Rows, repeated ones and ones with a null
    id included, are kept one for one.
    """

    def rows(batch):
        c = codec(path)
        ids = pa.array([c.encode(t) for t in texts(batch)], pa.list_(pa.int32()))
        return {"doc_id": batch.column("doc_id"), "ids": ids}

    src = keyed(df, doc_id=id_col, text=text_col)
    return arrow_map(src, rows, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` from ids; null ids are an empty text.

    An id that isn't in the vocabulary raises ``KeyError``.
    """

    def rows(batch):
        c = codec(path)
        out = [c.decode(ids or []) for ids in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "text": pa.array(out, pa.string())}

    src = keyed(df, doc_id=id_col, ids=ids_col)
    return arrow_map(src, rows, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass and return the digests.

    ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas),
    ``decoded_sha256`` (UTF-8 of the decoded text).  Same rows and null rules
    as :func:`encode`; the ids themselves never leave the worker.
    """

    def rows(batch):
        c, n, ids, decoded = codec(path), [], [], []
        gc.disable()  # nothing here is cyclic, and the remembered pieces are many
        for text in texts(batch):
            found = c.encode(text)
            n.append(len(found))
            ids.append(hashlib.sha256(",".join(map(c.name_of.__getitem__, found)).encode()).hexdigest())
            decoded.append(hashlib.sha256(c.decode_bytes(found)).hexdigest())
        gc.enable()
        return {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}

    src = keyed(df, doc_id=id_col, text=text_col)
    return arrow_map(src, rows, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
