"""Line dedup, periodic runs and hard negatives against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from resona.llm import entries, hard_negatives, line_dedup, periodic_runs

RND = random.Random(11)


# lines


def _key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def _without_common(texts, least, chars=1):
    count = Counter(k for t in texts for k in {_key(x) for x in (t or "").split("\n")} if len(k) >= chars)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(_key(x)) < chars or count[_key(x)] < least]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


LINES = ["menu", " MENU\t", "é", "É", "Ärger", "", " ", "one\r", "One", "\x0btwo\x0c", "two\xa0", "three words here", "x" * 5000, "漢"]
TEXTS = [None, "", "\n", "\n\n menu", *["\n".join(RND.choice(LINES) for _ in range(RND.randrange(1, 8))) for _ in range(40)], "\n".join(["menu"] * 3000), "\n".join(f"only here {k}" for k in range(3000))]


@pytest.mark.parametrize(("shard", "cached"), [(1 << 20, 1 << 20), (2, 1)])
def test_line_dedup(spark, monkeypatch, shard, cached):
    """With one shard, and with more shards than a worker keeps."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard)
    monkeypatch.setattr(line_dedup, "CACHE_BYTES", cached)
    rows = [(k, t, 0, None) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], 0, None), (None, "menu", 0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lines int, n_lines string").repartition(3)
    for least, chars in ((10, 1), (3, 2), (1, 1)):
        got = line_dedup.dedup_lines(docs, min_docs=least, min_chars=chars)
        assert got.columns == [*docs.columns, "lines_"]
        found = Counter((r.doc_id, r.lines_.n_lines, r.lines_.n_dropped, r.lines_.kept) for r in got.collect())
        assert found == Counter((r[0], *w) for r, w in zip(rows, _without_common([r[1] for r in rows], least, chars)))
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_index_serves_other_documents(spark):
    docs = spark.createDataFrame([("common\nmine",), ("common\nyours",), ("Common ",)], "t string")
    index = line_dedup.build_index(docs, "t", 3)
    new = spark.createDataFrame([("COMMON\nmine\nyours",)], "t string")
    assert [r.lines.kept for r in line_dedup.drop_lines(new, index, "t", 3).collect()] == ["mine\nyours"]
    with pytest.raises(ValueError, match="fewer than 2"):
        line_dedup.drop_lines(new, index, "t", 1)


def test_shard_is_a_minimal_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        h = rng.integers(0, 2**64, (n, 2), np.uint64)
        h[: n // 10, 0] = 7  # equal first halves
        counts = rng.integers(2, 70_000, n)
        shard = line_dedup.Shard.build(h, counts)
        assert sorted(shard.slots(h).tolist()) == list(range(n)) and (shard.find(h) == counts).all()
        assert not shard.find(rng.integers(0, 2**64, (500, 2), np.uint64)).any()
        assert n < 1000 or shard.nbytes < 13.5 * n


# runs


def _runs(w, least, times):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length, part = j - i + q, w[i : j + q]
            if j > i and length >= max(least, times * q) and not any(part[r:] == part[: length - r] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _words(alphabet, n):
    w = [b"%d" % RND.randrange(alphabet) for _ in range(n)]
    for _ in range(RND.randrange(3)):  # a piece repeated, with an end cut off
        at, size = RND.randrange(len(w) + 1), RND.randrange(1, 9)
        piece = [b"%d" % RND.randrange(alphabet) for _ in range(size)] * RND.randrange(2, 8)
        w[at:at] = piece[: len(piece) - RND.randrange(size)]
    return w


@pytest.mark.parametrize(("least", "times"), [(6, 4), (1, 2), (9, 3)])
def test_runs_equal_brute_force(monkeypatch, least, times):
    for group in (1 << 17, 20):  # all stretches in one sequence, and in many
        monkeypatch.setattr(periodic_runs, "GROUP_WORDS", group)
        for _ in range(250):
            texts = [_words(RND.choice([1, 2, 3, 5, 40]), RND.randrange(60)) for _ in range(RND.randrange(1, 6))]
            assert periodic_runs.find_runs(texts, least, times) == [_runs(w, least, times) for w in texts]


def test_vocabulary_is_complete():
    """Every primitively rooted square of a sequence is in the tree's vocabulary, and nothing else."""
    for _ in range(200):
        w = [RND.randrange(2) for _ in range(RND.randrange(2, 50))]
        s = periodic_runs.Sequence(np.array([*w, 9]))
        start, period = periodic_runs.covering_squares(s)
        tree = periodic_runs.Tree(s)
        found = {tuple(s.symbols[s.suffixes[tree.low[v]] :][:d].tolist()) for v, d in tree.vocabulary(start, period)}
        halves = {tuple(w[i : i + k]) for k in range(1, len(w) // 2 + 1) for i in range(len(w) - 2 * k + 1) if w[i : i + k] == w[i + k : i + 2 * k]}
        assert found == {h * 2 for h in halves if not any(h == h[:d] * (len(h) // d) for d in range(1, len(h)) if len(h) % d == 0)}


def test_runs_of_long_texts():
    assert periodic_runs.find_runs([[b"a"] * 100_000]) == [[(0, 100_000, 1)]]
    period = [b"%d" % k for k in range(1000)]
    assert periodic_runs.find_runs([[b"x", *period * 50, b"y"], period * 3]) == [[(1, 50_000, 1000)], []]


def test_runs_of_documents(spark):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "é é\xa0é", "x\x1cy " * 6, "b " + "c d " * 5 + "e", "word " * 5000, "A a " * 4]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(5, texts[5], 1), (None, texts[8], 1)], "doc_id long, text string, runs int").repartition(3)
    got = periodic_runs.with_runs(docs)
    assert got.columns == ["doc_id", "text", "runs", "runs_"]
    for r in got.collect():
        w = [x.encode() for x in re.findall("[^\x20\x09-\x0d]+", r.text or "")]
        want = _runs(w, 6, 4)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert (r.runs_.n_words, [tuple(x) for x in r.runs_.runs]) == (len(w), want)
        assert r.runs_.collapsed == b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
    assert periodic_runs.with_runs(docs.limit(0)).count() == 0


def test_op12_query(spark, tmp_path):
    """The whole query against plain Python, planted repetitions and all."""
    texts = [None, "", "a b", *[" ".join(RND.choice("abcdefgh") for _ in range(RND.randrange(1, 120))) for _ in range(200)]]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, "a " * 9)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    planted = 0
    for r in entries.op12_periodic_runs(spark, str(tmp_path)).collect():
        w = ["a"] * 9 if r.doc_id is None else (texts[r.doc_id] or "").split()
        n, h = len(w), 1 if r.doc_id is None else zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            planted += 1
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = _runs(w, 6, 4)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else (None, None, None)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best) and r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)) and r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    assert planted > 5


# negatives


def _mined(rows, anchor, positives, negatives, percent):
    whole = [(k, y, [math.floor(256 * x) for x in v]) for k, y, v in rows]
    out = set()
    for a, y, v in whole:
        if not anchor(a):
            continue
        scored = sorted(((-sum(p * q for p, q in zip(v, w)), k, z) for k, z, w in whole if k != a))
        for s, p, _ in [x for x in scored if x[2] == y][:positives]:
            far = [(t, k) for t, k, z in scored if z != y and percent * -s <= 100 * -t <= 100 * -s][:negatives]
            out |= {(a, p, rank, k, -s, -t) for rank, (t, k) in enumerate(far, 1)}
    return out


@pytest.mark.parametrize(("rows", "anchors"), [(1 << 13, 1 << 10), (7, 3)])
@pytest.mark.parametrize("scale", [1.0, 0.01, 1e6])
def test_hard_negatives(spark, monkeypatch, rows, anchors, scale):
    """With one block and with many, with ties, and with scores that doubles can't hold exactly."""
    monkeypatch.setattr(hard_negatives, "ROWS", rows)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    rng = np.random.default_rng(5)
    x = rng.normal(0.3, 1, (150, 6)).astype(np.float32) * np.float32(scale)
    x[20:60] = x[20]
    y = rng.integers(0, 4, 150)
    y[140] = 9  # an anchor without positives
    good = [(k, int(c), v.tolist()) for k, (v, c) in enumerate(zip(x, y))]
    odd = [(200, None, good[0][2]), (210, 1, None), (220, 1, [math.nan] * 6), (230, 1, [math.inf] * 6), (240, 1, [None] * 6), (250, 1, [1.0]), (None, 1, good[0][2]), good[3]]
    d = spark.createDataFrame(good + odd, "vec_id long, label int, embedding array<float>").withColumn("block", F.lit("x")).repartition(3)
    got = [tuple(r) for r in hard_negatives.mine(d, F.col("id") % 10 == 0, positives=4, negatives=3, percent=70).collect()]
    want = _mined(good, lambda k: k % 10 == 0, 4, 3, 70)
    assert len(got) == len(set(got)) and want and set(got) == want
    assert hard_negatives.mine(d.limit(0), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.mine(d, F.lit(False)).count() == 0


def test_scores_beyond_64_bits_are_an_error():
    m = np.full((1, 2), 2.0**40)
    with pytest.raises(OverflowError):
        hard_negatives._scores(m, m)
