"""Best-fit packing planned over the histogram of lengths.

1. Each text becomes ids once; its pieces of at most ``CONTEXT`` ids keep
   only their length and checksum (a written table).
2. The histogram has at most ``CONTEXT`` entries whatever the corpus. Best
   fit, longest first, runs over its counts: bins with the same filling are one
   group, and a length fills a whole group at a time.
3. The plan lists for each length which ranks take which sequences. Pieces
   are ranked within (length, one of ``SALTS`` parts) and the parts'
   counts are added up, so that a length that a third of all pieces share is
   no single task; they take their slots by a join on length and rank.

Null texts count as empty: a document is its ids and the end id 0, so it has
one piece at least. Repeated rows are packed one by one. Empty input gives no
rows.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHE_BYTES, ENTRY_BYTES, held, map_columns, written
from .token_counts import added_of, new_library

CONTEXT = 2048
END = 0
#: Parts of each length that are ranked apart.
SALTS = 256
#: Beyond these characters, lower case and composition are left to the library.
_UNUSUAL = re.compile(r"[^\t-\r\x20-\x7e\xa0-įı-ſ‐-‧]")
#: In such texts these are what the library encodes one by one.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿĀ-ſ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ÿĀ-ſ0-9²³¹¼-¾]+")
#: What the library's last token of a word ends with.
_LAST = "</w>"


class _Numbers(dict):
    """Words to numbers, in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class WordIds:
    """Texts to the library's ids, with a bounded table of words and their ids.

    The library gets a batch's new words as one text and without what finds
    words in it, since a call for each word takes longer than its merges.
    """

    def __init__(self, path: str):
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.library = new_library(path)  # goes when this goes
        self.added = added_of(self.library)
        self.plain = new_library(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.plain.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for token, k in vocabulary.items() if token.endswith(_LAST)]] = True
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.ends, self.chars = _Numbers(), np.empty(0, "<u4"), np.zeros(1, np.int64), 0

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        ids = np.array(self.plain.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(new):  # each word has one last token
            each = self._library(new)
            ids, ends = np.concatenate(each), np.cumsum(list(map(len, each)))
        self.chars += sum(map(len, new))
        self.ends = np.concatenate([self.ends, len(self.ids) + ends])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.added
        split = [None if _UNUSUAL.search(t) or found and found.search(t) else _PARTS.findall(t.lower()) for t in texts]
        usual = [some for some in split if some is not None]
        if len(self.words) * ENTRY_BYTES + 4 * len(self.ids) + self.chars > CACHE_BYTES:
            self._forget()
        known = len(self.words)
        words = np.fromiter(map(self.words.__getitem__, chain.from_iterable(usual)), np.int64)
        if len(self.words) > known:
            self._learn(list(islice(self.words, known, None)))
        size = np.diff(self.ends)[words]
        ends = np.cumsum(np.concatenate([[0], size]))
        ids = self.ids[np.repeat(self.ends[words] - ends[:-1], size) + np.arange(ends[-1])]
        bounds = ends[np.cumsum([0, *map(len, usual)])]
        each = iter([ids[a:b] for a, b in zip(bounds, bounds[1:])])
        return [(self._library([t])[0] if some is None else next(each)).tobytes() for t, some in zip(texts, split)]


def word_ids(path: str) -> WordIds:
    return held(("words", path), lambda: WordIds(path))


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", context: int = CONTEXT) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces."""
    kind = docs.schema[key].dataType.simpleString()
    step, end = 4 * context, END.to_bytes(4, "little")

    def fn(x: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("key", "piece", "start", "length", "ids_crc32")}
        for k, ids in zip(x["key"], word_ids(path).encode([t or "" for t in x["text"]])):
            ids += end
            for i, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                for name, value in zip(out, (k, i, at // 4, len(part) // 4, zlib.crc32(part))):
                    out[name].append(value)
        return out

    got = map_columns(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), fn, f"key {kind}, piece int, start long, length long, ids_crc32 long")
    return got.withColumnRenamed("key", key)


def plan(counts: dict[int, int], context: int = CONTEXT) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, slots of this length in each sequence, offset of the first slot).

    Best fit, longest first: each item goes where the least room is left.
    """
    groups: dict[int, list[list]] = {}  # by the room left: [sequences, their slots]
    out: list[tuple[int, list]] = []

    def fill(group: list, sequences: int, length: int, slots: int) -> None:
        """So many sequences of the group take so many slots each."""
        if sequences == 0:
            return
        room = context - sum(a * b for a, b in group[1])
        new = [sequences, [*group[1], (length, slots)]]
        group[0] -= sequences
        groups.setdefault(room - length * slots, []).append(new)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r, x in groups.items() if r >= length and x), default=None)
            if room is None:
                groups.setdefault(context, []).append([-(-left // (context // length)), []])
                room = context
            group, each = groups[room][-1], room // length
            used = left // each if left < each * group[0] else group[0]
            if used == 0:
                used, each = 1, left
            fill(group, used, length, each)
            left -= used * each
            if group[0] == 0:
                groups[room] = [g for g in groups[room] if g is not group]
    sequence, ranks = 0, dict.fromkeys(counts, 0)
    for n, slots in (g for x in groups.values() for g in x):
        offset = 0
        for length, each in slots:
            out.append((length, ranks[length], n * each, sequence, each, offset))
            ranks[length] += n * each
            offset += length * each
        sequence += n
    return out


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", context: int = CONTEXT) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    found = written(pieces(docs, path, key, text, context), "pieces").withColumn("part", F.pmod(F.xxhash64(key, "piece"), F.lit(SALTS)))
    counts = found.groupBy("length", "part").count()
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # context entries at most
    slots = spark.createDataFrame(plan(histogram, context), "length long, first_rank long, n_ranks long, first_sequence long, each long, first_offset long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).select("length", "part", "base")
    within = Window.partitionBy("length", "part").orderBy(key, "piece", "ids_crc32")
    ranked = found.withColumn("r", F.row_number().over(within) - 1).join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("r"))
    # the plan is bounded by the number of lengths, not by the corpus
    s = F.broadcast(slots.withColumnRenamed("length", "slot_length"))
    taken = ranked.join(s, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n_ranks")))
    at = F.col("rank") - F.col("first_rank")
    return taken.select(
        key, "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(at / F.col("each"))).alias("sequence_id"),
        (F.col("first_offset") + (at % F.col("each")) * F.col("length")).alias("offset"),
    )
