"""Stretches of words that repeat periodically, by the tandem repeats of a suffix tree.

A run is a stretch of consecutive words with smallest period q (words q apart
are the same), of at least ``MIN_WORDS`` words and ``MIN_EXPONENT`` periods, that no neighbouring
word extends. All of them are found, in texts of any length:

0. Every word of a run occurs in it ``MIN_EXPONENT`` times at least. So words that are rarer
   than that in their stretch cut it, again and again until nothing is cut: what is left
   holds every run, and of plain prose next to nothing is left. The stretches of many
   texts make one sequence, each ended by a symbol of its own.
1. Ranks of all stretches of 2, 4, 8 ... words give the suffix array and the longest
   common extensions to both sides, and with them the suffix tree: its nodes are the
   intervals of suffixes with a common beginning, with parents, children and suffix links.
2. Ziv-Lempel blocks: the leftmost occurrence of a square (a word sequence twice in a row)
   meets the border of a block, so extensions around each border, for as many periods as the two
   blocks beside it are long, give squares that cover all leftmost ones.
3. These are marked in the tree at their depth. A walk by suffix links from each mark,
   as long as the first word follows again, marks the rotated squares:
   the whole vocabulary. Squares whose half is itself a repetition are left out, since
   a shorter period holds there.
4. The leaves below a mark are the square's occurrences. Those of one period that begin
   at neighbouring words merge into a run.

Steps 1 to 4 work on at most ``GROUP_WORDS`` words of stretches at a time, unless one
is longer. Null and empty texts have no words and no runs. Other columns are
passed on; an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, small_batches, text_udf

MIN_WORDS, MIN_EXPONENT = 6, 4
GROUP_WORDS = 1 << 17
RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for n entries each."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(begin - (ends - n), n)


class Minima:
    """Least values of all stretches of 2**k entries, to walk from an entry while no value is below a bound."""

    def __init__(self, values: np.ndarray):
        self.n, self.tables = len(values), [values]
        while 2 << len(self.tables) - 1 <= self.n:
            t, h = self.tables[-1], 1 << len(self.tables) - 1
            self.tables.append(np.minimum(t[:-h], t[h:]))

    def right(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last index up to which all values after at are at least the bound."""
        at = at.copy()
        for k in range(len(self.tables) - 1, -1, -1):
            fits = at + (1 << k) < self.n
            fits[fits] = self.tables[k][at[fits] + 1] >= bound[fits]
            at[fits] += 1 << k
        return at

    def left(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first index such that all values after it, up to that at ``at``, are at least the bound."""
        at = at.copy()
        for k in range(len(self.tables) - 1, -1, -1):
            fits = at - (1 << k) >= 0
            fits[fits] = self.tables[k][at[fits] - (1 << k) + 1] >= bound[fits]
            at[fits] -= 1 << k
        return at


class Sequence:
    """A sequence of symbols with its suffix array and common extensions."""

    def __init__(self, symbols: np.ndarray):
        self.symbols, self.n, self.ranks = symbols, len(symbols), []
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        while True:
            self.ranks.append(rank)
            step = 1 << len(self.ranks) - 1
            if step >= self.n or rank.max() == self.n - 1:
                break
            after = np.zeros(self.n, np.int64)
            after[: self.n - step] = rank[step:] + 1
            rank = np.unique(rank * (self.n + 1) + after, return_inverse=True)[1].astype(np.int64)
        self.rank = self.ranks[-1]  # all different: the last symbol is like no other
        self.suffixes = np.argsort(self.rank)
        self.lcp = np.zeros(self.n, np.int64)  # of a suffix and the one before it in order
        self.lcp[1:] = self.common(self.suffixes[:-1], self.suffixes[1:])
        self.minima = Minima(self.lcp)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on are the same; i and j differ."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            same = (i < self.n) & (j < self.n)
            same[same] = self.ranks[k][i[same]] == self.ranks[k][j[same]]
            for x in (i, j, out):
                x[same] += 1 << k
        return out

    def common_before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols that end at i and at j are the same; i and j differ and may be -1."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            n = 1 << k
            same = (i >= n - 1) & (j >= n - 1)
            same[same] = self.ranks[k][i[same] - n + 1] == self.ranks[k][j[same] - n + 1]
            i[same] -= n
            j[same] -= n
            out[same] += n
        return out

    def interval(self, rank: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last suffix, by rank, that share so many symbols with that of a rank."""
        return self.minima.left(rank, depth), self.minima.right(rank, depth)

    def blocks(self) -> np.ndarray:
        """Where Ziv-Lempel blocks begin, and the end: a block is the longest that occurs earlier too, or one symbol."""
        earlier = Minima(self.suffixes)
        at = np.arange(self.n)
        before, after = earlier.left(at, self.suffixes), earlier.right(at, self.suffixes) + 1
        longest = np.zeros(self.n, np.int64)
        for r, other, known in ((at, before, self.suffixes[before] < self.suffixes), (at, after, after < self.n)):
            r, other = r[known], other[known]
            longest[self.suffixes[r]] = np.maximum(longest[self.suffixes[r]], self.common(self.suffixes[r], self.suffixes[other]))
        steps, out, i = np.maximum(longest, 1).tolist(), [], 0
        while i < self.n:
            out.append(i)
            i += steps[i]
        return np.array([*out, self.n])


@cache
def _prime_factors(k: int) -> tuple[int, ...]:
    out, p = [], 2
    while p * p <= k:
        if k % p == 0:
            out.append(p)
            while k % p == 0:
                k //= p
        p += 1
    return (*out, k) if k > 1 else tuple(out)


def covering_squares(s: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of squares; each leftmost one is among them or follows one of its period without a gap."""
    begin = s.blocks()
    h, q = begin[:-1], begin[1:]
    size = q - h
    beside = size + np.append(size[1:], 0)
    starts, periods = [], []
    # the right half crosses the block's end
    inner = q < s.n
    c, k = np.repeat(q[inner], size[inner]), _spread(np.ones(inner.sum(), np.int64), size[inner])
    ahead, back = s.common(c, c - k), s.common_before(c - 1, c - k - 1)
    found = (ahead > 0) & (ahead + back >= k)
    starts.append(np.maximum(c - k - back, c - 2 * k + 1)[found])
    periods.append(k[found])
    # the left half crosses the block's begin
    c, k = np.repeat(h, beside), _spread(np.ones(len(h), np.int64), beside)
    c, k = c[c + k < s.n], k[c + k < s.n]
    ahead, back = s.common(c, c + k), s.common_before(c - 1, c + k - 1)
    first = np.maximum(c - back, c - k)
    found = (back > 0) & (first <= c + ahead - k)
    starts.append(first[found])
    periods.append(k[found])
    start, period = np.divmod(np.unique(np.concatenate(starts) * s.n + np.concatenate(periods)), s.n)
    factors = [_prime_factors(k) for k in period.tolist()]
    n = np.array([len(f) for f in factors], np.int64)
    owner, shorter = np.repeat(np.arange(len(period)), n), np.array([k // p for k, f in zip(period.tolist(), factors) for p in f], np.int64)
    repeated = s.common(start[owner], start[owner] + shorter) >= period[owner] - shorter
    whole = np.bincount(owner[repeated], minlength=len(period)) == 0
    return start[whole], period[whole]


class Tree:
    """The suffix tree of a sequence: nodes 0 to n - 1 are leaves by rank, the others inner nodes, the root the last."""

    def __init__(self, s: Sequence):
        self.s, n = s, s.n
        low, high = s.interval(np.arange(1, n), s.lcp[1:])
        low, high = np.divmod(np.unique(np.append(low * n + high, n - 1)), n)
        order = np.argsort(high - low, kind="stable")  # the root spans all
        self.low = np.concatenate([np.arange(n), low[order]])
        self.high = np.concatenate([np.arange(n), high[order]])
        keys = self.low * n + self.high
        self._node = np.argsort(keys)
        self._key = keys[self._node]
        root = len(keys) - 1
        edge = np.append(s.lcp, 0)
        inner = np.arange(n, len(keys))
        depth = np.concatenate([n - s.suffixes, np.zeros(len(inner), np.int64)])
        bounds = np.maximum(edge[self.low], edge[self.high + 1])  # the depth of the node above
        parent = self.at(self.low, bounds)
        depth[parent[:-1]] = bounds[:-1]
        link = np.full(len(keys), root)
        deep = inner[depth[inner] > 0]
        link[deep] = self.at(s.rank[s.suffixes[self.low[deep]] + 1], depth[deep] - 1)
        first = s.symbols[s.suffixes[self.low[:-1]] + bounds[:-1]]
        self.width = int(s.symbols.max()) + 1
        self.child = dict(zip((parent[:-1] * self.width + first).tolist(), range(root)))
        self.parent, self.link, self.depth, self.root = parent.tolist(), link.tolist(), depth.tolist(), root

    def at(self, rank: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The node at or next below a depth on the way to a leaf."""
        low, high = self.s.interval(rank, depth)
        return self._node[np.searchsorted(self._key, low * self.s.n + high)]

    def vocabulary(self, start: np.ndarray, period: np.ndarray) -> set[tuple[int, int]]:
        """(node below, depth) of the squares and of all their rotations that occur."""
        symbols, leaf = self.s.symbols.tolist(), self.s.suffixes[self.low].tolist()
        child, parent, link, depth, width = self.child, self.parent, self.link, self.depth, self.width
        marked: set[tuple[int, int]] = set()
        for v, d in zip(self.at(self.s.rank[start], 2 * period).tolist(), (2 * period).tolist()):
            while (v, d) not in marked:
                marked.add((v, d))
                i, x = leaf[v], link[parent[v]]
                while depth[x] < d - 1:  # down to where the square without its first word is
                    x = child[x * width + symbols[i + 1 + depth[x]]]
                if depth[x] == d - 1:
                    x = child.get(x * width + symbols[i], -1)
                    if x < 0:
                        break
                elif symbols[leaf[x] + d - 1] != symbols[i]:
                    break
                v = x
        return marked


def merged(start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs that occurrences of squares make up."""
    order = np.lexsort((start, period))
    start, period = start[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return start[first], start[last] - start[first] + 2 * period[first], period[first]


def sequence_runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs of two periods or more; the last symbol is like no other."""
    s = Sequence(symbols)
    start, period = covering_squares(s)
    none = np.empty(0, np.int64)
    if not len(start):
        return none, none, none
    tree = Tree(s)
    node, depth = np.array(sorted(tree.vocabulary(start, period)), np.int64).T
    n = tree.high[node] - tree.low[node] + 1
    return merged(s.suffixes[_spread(tree.low[node], n)], np.repeat(depth // 2, n))


def stretches(symbols: np.ndarray, text: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions that may lie in a run, and the number of the stretch of each: in it every symbol occurs so many times."""
    at, part = np.arange(len(symbols)), text
    width = int(symbols.max(initial=0)) + 1
    while True:
        _, which, n = np.unique(part * width + symbols[at], return_inverse=True, return_counts=True)
        often = n[which] >= times
        at, was = at[often], part[often]
        cut = np.ones(len(at), bool)
        cut[1:] = (at[1:] != at[:-1] + 1) | (was[1:] != was[:-1])
        part = np.cumsum(cut) - 1
        long = np.bincount(part)[part] >= least
        at, part = at[long], part[long]
        if often.all() and long.all():
            return at, part


def find_runs(texts: list[list[bytes]], least: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start, then period."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    symbols = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, sizes.sum())
    text, begin = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    at, part = stretches(symbols, text, max(least, exponent), exponent)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(at) else np.empty(0, np.int64)
    lo = 0
    while lo + 1 < len(edges):  # as many stretches as fit
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + GROUP_WORDS, "right")) - 1)
        group = at[edges[lo] : edges[hi]]
        ends = edges[lo + 1 : hi + 1] - edges[lo]
        own = np.insert(symbols[group], ends, len(known) + np.arange(len(ends)))
        place = np.insert(group, ends, -1)
        for s, n, q in zip(*(x.tolist() for x in sequence_runs(own))):
            if n >= max(least, exponent * q):
                t = int(text[place[s]])
                out[t].append((int(place[s] - begin[t]), n, q))
        lo = hi
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    inside = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        inside[start + period] += 1
        inside[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(inside).tolist()) if not n]


def runs_column(docs: DataFrame) -> str:
    """The name of the column that ``with_runs`` adds."""
    return fresh_name(docs, "runs")


def with_runs(docs: DataFrame, text: str = "text", least: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> DataFrame:
    """docs with a struct of n_words, runs and collapsed (the kept words, joined by one space)."""
    small_batches(docs.sparkSession)

    def fn(texts: list) -> dict[str, list]:
        words = [(t or "").encode().split() for t in texts]  # of bytes: ASCII white space only
        runs = find_runs(words, least, exponent)
        as_rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
        return {"n_words": [len(w) for w in words], "runs": as_rows, "collapsed": [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, runs)]}

    return docs.withColumn(runs_column(docs), text_udf(fn, RESULT)(F.col(text).cast("string")))
