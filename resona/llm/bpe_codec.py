"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each position holds the rank of the pair that it begins, or NONE. A tree of
minima over ``rank * width + position`` has the leftmost pair of least rank
at its root. A merge changes the leaf of the merged pair, of its live
neighbour on the left and of the one that it swallows, each an update of
log(width) nodes. Short pre-tokens go through the same tree side by side, a
numpy row each; longer ones have a tree of their own. Every distinct
pre-token is encoded once per worker as long as the bounded cache holds it.

Nulls count as empty texts; an empty text has no ids, and the SHA-256 of
nothing. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from .common import Recent, held, map_columns
from .pretokens import chunks, split

NONE = 1 << 62
#: Byte width up to which pre-tokens share one array; longer ones have their own tree.
WIDE = 64
#: Rows of one shared array.
SIDE_BY_SIDE = 8192


class Ranks:
    """A vocabulary by rank, and the rank of the merge of each pair of its tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.first = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.first < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        pairs = {(self.ids[t[:k]] << 32) | self.ids[t[k:]]: i for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids}
        self.pair_rank = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; NONE where it is no token or right is -1."""
        key = (left << 32) | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.merged[at], NONE)


@cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


def encode_side_by_side(pieces: list[bytes], r: Ranks, width: int) -> list[bytes]:
    """The ids, as bytes, of pieces of at most width bytes; width is a power of two."""
    n = len(pieces)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
    size = np.array([len(p) for p in pieces])
    place = np.arange(width)
    live = place < size[:, None]
    ids = np.where(live, r.first[raw], -1)
    after = np.where(place + 1 < size[:, None], place + 1, width)  # width: nothing follows
    before = np.broadcast_to(place - 1, (n, width)).copy()
    right = np.concatenate([ids[:, 1:], np.full((n, 1), -1)], axis=1)
    leaf = r.rank_of(ids, right)
    tree = np.full((n, 2 * width), NONE, np.int64)
    tree[:, width:] = np.where(leaf < NONE, leaf * width + place, NONE)
    for k in range(width - 1, 0, -1):
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

    def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        node = at + width
        tree[rows, node] = value
        for _ in range(width.bit_length() - 1):
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def pair(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        nxt = after[rows, at]
        right = np.where(nxt < width, ids[rows, np.minimum(nxt, width - 1)], -1)
        rank = r.rank_of(ids[rows, at], right)
        return np.where(rank < NONE, rank * width + at, NONE)

    rows = np.flatnonzero(tree[:, 1] < NONE)
    while rows.size:
        best = tree[rows, 1]
        at, rank = best % width, best // width
        gone = after[rows, at]
        ids[rows, at] = rank
        ids[rows, gone] = -1
        beyond = after[rows, gone]
        after[rows, at] = beyond
        inside = beyond < width
        before[rows[inside], beyond[inside]] = at[inside]
        update(rows, gone, np.full(rows.size, NONE))
        update(rows, at, pair(rows, at))
        left = before[rows, at]
        has = left >= 0
        update(rows[has], left[has], pair(rows[has], left[has]))
        rows = rows[tree[rows, 1] < NONE]
    kept = ids >= 0
    flat = ids[kept].astype("<u4").tobytes()
    ends = (np.cumsum(kept.sum(axis=1)) * 4).tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def encode_alone(piece: bytes, r: Ranks) -> bytes:
    """The ids, as bytes, of one piece of any length."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    ids = r.first[np.frombuffer(piece, np.uint8)].tolist()
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    rank_of = r.pair_rank.get
    tree = [NONE] * (2 * width)

    def pair(at: int) -> int:
        rank = rank_of((ids[at] << 32) | ids[after[at]]) if after[at] >= 0 else None
        return NONE if rank is None else rank * width + at

    for at in range(n):
        tree[width + at] = pair(at)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def update(at: int, value: int) -> None:
        node = at + width
        tree[node] = value
        while node > 1:
            value = min(tree[node], tree[node ^ 1])
            node >>= 1
            if tree[node] == value:
                break
            tree[node] = value

    while tree[1] < NONE:
        rank, at = divmod(tree[1], width)
        gone = after[at]
        ids[at], ids[gone] = rank, -1
        after[at] = beyond = after[gone]
        if beyond >= 0:
            before[beyond] = at
        update(gone, NONE)
        update(at, pair(at))
        if before[at] >= 0:
            update(before[at], pair(before[at]))
    return np.array([i for i in ids if i >= 0], "<u4").tobytes()


class Encoder:
    """Texts to ids, with bounded caches of what pre-tokens and chunks of several give."""

    def __init__(self, path: str):
        self.ranks = ranks(path)
        self.pieces, self.known = Recent(), Recent()

    def _learn(self, new: set[str]) -> None:
        parts = {c: split(c) for c in new}
        missing = {p: p.encode() for p in self.pieces.missing({p for x in parts.values() for p in x})}
        found: dict[str, bytes] = {}
        by_width: dict[int, list[str]] = {}
        for p, raw in missing.items():
            whole = self.ranks.ids.get(raw)
            if whole is not None:  # a piece that is a token is not merged
                found[p] = whole.to_bytes(4, "little")
            else:
                by_width.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append(p)
        for width, names in by_width.items():
            if width > WIDE:
                found.update((p, encode_alone(missing[p], self.ranks)) for p in names)
                continue
            for k in range(0, len(names), SIDE_BY_SIDE):
                some = names[k : k + SIDE_BY_SIDE]
                found.update(zip(some, encode_side_by_side([missing[p] for p in some], self.ranks, width)))
        self.pieces.add(found)
        pieces = self.pieces.young
        self.known.add({c: b"".join([pieces[p] for p in x]) for c, x in parts.items()})

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        each = [chunks(t) for t in texts]
        self._learn(self.known.missing({c for some in each for c in some}))
        known = self.known.young
        return [b"".join(map(known.__getitem__, some)) for some in each]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str) -> Encoder:
    return held(("codec", path), lambda: Encoder(path))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' key with the ids of the text (ids, binary: unsigned 32-bit, little-endian) and what they decode to (decoded, binary)."""
    kind = docs.schema[key].dataType.simpleString()

    def fn(x: dict[str, list]) -> dict[str, list]:
        coder = encoder(path)
        ids = coder.encode([t or "" for t in x["text"]])
        return {"key": x["key"], "ids": ids, "decoded": [coder.decode(i) for i in ids]}

    got = map_columns(docs.select(docs[key].alias("key"), docs[text].alias("text")), fn, f"key {kind}, ids binary, decoded binary")
    return got.withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """n_tokens and the SHA-256 of the ids and of the decoded bytes, without sending either to the JVM."""
    kind = docs.schema[key].dataType.simpleString()
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def fn(x: dict[str, list]) -> dict[str, list]:
        coder = encoder(path)
        ids = coder.encode([t or "" for t in x["text"]])
        return {"key": x["key"], "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [sha(i) for i in ids], "decoded_sha256": [sha(coder.decode(i)) for i in ids]}

    got = map_columns(docs.select(docs[key].alias("key"), docs[text].alias("text")), fn, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return got.withColumnRenamed("key", key)
