"""Toxicity of texts that are first restored through a noisy channel.

Channel: a writer hides a word by digits and symbols that look like letters, by
separators or spaces between its letters, and by repeating letters. The
lattice of what each written character may stand for is decoded by Viterbi
under a character trigram model, whose counts come from every document (a
table of ``CLASSES`` ** 3 entries, whatever the corpus). Plain words without a
letter twice in a row have one reading and skip the lattice, and so do pure
numbers; in words of letters alone each doubled letter is a lattice of its own; every other chunk is decoded, whatever its length. A run of one character counts as three of it. Dropping one of two equal letters costs the more
the likelier that letter stands twice in the counts; in longer runs it is cheap.
Only true punctuation is cut off at the ends; other signs there may be skipped
by the lattice. A decoded chunk is also known by the words that stand in it as
they are written. Single letters or look-alikes apart by white space are one
word where that is likelier.

Score: words and word beginnings of the restored text are weighed by their
log-odds in toxic against clean training documents; a logistic regression
over how strong, how many and how dense such words are gives the score. At
most ``SAMPLE`` labelled documents train it (those of the smallest hash, of near
copies one), which also bounds the weights. The regression sees
weights from the half of the sample that its document is not in.

Labels, lang, source and doc_id are no input of a score. A null or empty text
has no words and scores as a text without toxic words. Without both labels in
the sample every score is the share of toxic labels (0 without labels).
Repeated rows are scored one by one.
"""

from __future__ import annotations

import math
import os.path
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, fresh_name, held, map_columns, sampled_labels, small_batches, text_udf

SAMPLE = 12_000
#: Training documents with a unit, and the log-odds, from which on it counts.
LEAST_DOCS, LEAST_WEIGHT = 3, 1.5
FOLDS = 5
#: Boundary, a to z, other letters.
CLASSES = 28

#: Letters that look-alikes may stand for.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
_SEPARATORS = frozenset("-_.*~'`^:/\\,")
_LOOK, _SKIP, _REPEAT, _KEEP = -1.5, -1.0, -0.7, -6.0
#: The price of dropping the second of two equal letters: the likelier a letter stands twice in the counts, the higher.
_TWO, _LIKELY = -5.5, -0.5
_PLAIN = re.compile(r"[^\W\d_]+\Z")
_WORDS = re.compile(r"[^\W\d_]+")
_TWICE = re.compile(r"(.)\1")
_THRICE = re.compile(r"(.)\1\1")
_RUN = re.compile(r"(.)\1{3,}", re.S)
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "$@!|+(<")
_ENDS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Digits with signs around and between them; "4$$" is none.
_NUMBER = re.compile(r"[^\w@]*\d+(?:(?:[^\w@$!]|_)+\d+)*[^\w@$!]*[$!]?\Z")
_SIGNS = "".join(c for c in LOOKS if not c.isalnum())
_ONE = f"(?:[^\\W_]|[{re.escape(_SIGNS)}])"
_SPACED = re.compile(f"(?<!\\S)[{re.escape(_EDGE)}]*(?:{_ONE}\\s+){{2,}}{_ONE}[{re.escape(_EDGE)}!]*(?!\\S)")
#: Characters between two that are handed out of the lattice.
_FLUSH = 64


def _class_of(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


_TABLE = np.array([_class_of(chr(k).lower()[0]) for k in range(0x250)], np.int64)


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of class trigrams over all texts; each task sends CLASSES ** 3 numbers at most, added up by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            found = [np.empty(0, np.int64)]
            for t in batch.column(0).to_pylist():
                points = np.frombuffer(f" {t or ''} ".encode("utf-32-le"), "<u4")
                k = np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], 27)
                k = k[np.concatenate([[True], (k[1:] != 0) | (k[:-1] != 0)])]
                found.append((k[:-2] * CLASSES + k[1:-1]) * CLASSES + k[2:])
            total += np.bincount(np.concatenate(found), minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["trigram", "n"])

    small_batches(docs.sparkSession)
    got = docs.select(F.col(text).alias("text")).mapInArrow(count, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(CLASSES**3, np.int64)
    for r in got:
        out[r.trigram] = r.n
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), smoothed by the bigram and the letter."""
    three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
    one = three.sum(axis=(0, 1)) + 1
    one /= one.sum()
    two = three.sum(axis=0) + 5 * one
    two /= two.sum(axis=1, keepdims=True)
    return np.log((three + 5 * two) / (three.sum(axis=2, keepdims=True) + 5))


class Restorer:
    """Viterbi decoding of single words, with a bounded cache."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.known = Recent()
        # whatever stands before it; a run of three or more is nobody's spelling, and cheap
        twice = np.log(np.exp(model).mean(axis=0).diagonal())
        self.two = np.minimum(_REPEAT, _TWO + _LIKELY * twice).tolist()

    def word(self, chunk: str) -> str:
        """The restored word, in lower case."""
        low = chunk.lower()
        core = low.strip(_EDGE)
        if _PLAIN.match(core):  # quicker than to look it up
            if not _TWICE.search(core):
                return core
            if not _THRICE.search(core):
                return self._letters(core)
        if self.known.missing({low}):
            self.known.add({low: self._restore(low)})
        return self.known.young[low]

    def _restore(self, low: str) -> str:
        core = low.strip(_EDGE)
        if not core or _NUMBER.match(core):
            return ""
        return self.decode(core)

    def _letters(self, word: str) -> str:
        """``decode`` of letters of which none stands thrice in a row: whether one of two equal letters
        goes changes the likelihoods of these two and of the next letter only, so each pair is decided alone.
        """
        out, done, last = [], 0, len(word)
        for m in _TWICE.finditer(word):
            at, end = m.span()
            a, x, after = _class_of(word[at - 1]) if at else 0, _class_of(word[at]), _class_of(word[end]) if end < last else 0
            if self.two[x] + self.model[a][x][after] > self.model[a][x][x] + self.model[x][x][after]:
                out.append(word[done : m.start() + 1])
                done = m.end()
        return "".join([*out, word[done:]])

    def decode(self, written: str) -> str:
        """The likeliest reading of what is written."""
        if _PLAIN.match(written) and not _THRICE.search(written):
            return self._letters(written)
        return self.lattice(written)

    def lattice(self, written: str) -> str:
        """The same by Viterbi, of whatever is written."""
        written = _RUN.sub(r"\1\1\1", written)
        best: dict[tuple[int, int, str], tuple[float, str]] = {(0, 0, ""): (0.0, "")}
        tail, done = len(written.rstrip(_ENDS)), []
        runs = [c * 3 in written[max(0, n - 2) : n + 3] for n, c in enumerate(written)]
        for n, c in enumerate(written):
            options = [(c, 0.0)] if c.isalpha() else [(x, _LOOK) for x in LOOKS.get(c, "")] + [(" ", _KEEP)]
            new: dict[tuple[int, int, str], tuple[float, str]] = {}
            for (a, b, last), (cost, text) in best.items():
                steps = [(x, cost + p + self.model[a][b][_class_of(x)], (b, _class_of(x), x)) for x, p in options]
                if c in _SEPARATORS or c in "$!|+(<" or n >= tail:
                    steps.append(("", cost + _SKIP, (a, b, last)))
                if any(x == last for x, _ in options if x != " "):
                    steps.append(("", cost + (_REPEAT if runs[n] or c != last else self.two[b]), (a, b, last)))
                for x, value, state in steps:
                    if state not in new or value > new[state][0]:
                        new[state] = (value, text + x)
            best = new
            if n % _FLUSH == _FLUSH - 1:  # what all readings share is settled, so that the time is linear
                same = os.path.commonprefix([text for _, text in best.values()])
                done.append(same)
                best = {state: (cost, text[len(same) :]) for state, (cost, text) in best.items()}
        end = max(best.items(), key=lambda s: (s[1][0] + self.model[s[0][0]][s[0][1]][0], s[1][1]))
        return " ".join(_WORDS.findall("".join(done) + end[1][1]))

    def readings(self, chunk: str) -> str:
        """The restored word, and the words that a chunk other than a plain word holds as it is written."""
        low = chunk.lower()
        if _PLAIN.match(low) and not _TWICE.search(low):
            return low
        word = self.word(chunk)
        written = _WORDS.findall(low)
        return word if " ".join(written) == word else " ".join([word, *written])

    def likelihood(self, text: str) -> float:
        a = b = 0
        total = 0.0
        for c in f"{text} ":
            k = _class_of(c)
            if k or b:  # boundaries in a row are one, as in the counts
                total += self.model[a][b][k]
                a, b = b, k
        return total

    def spaced(self, text: str) -> str:
        """The text with spelled-out words joined where the joined word is likelier."""

        def join(m: re.Match) -> str:
            letters = " ".join(m[0].lower().split()).strip(_EDGE)
            joined = letters.replace(" ", "")
            if _NUMBER.match(joined):
                return m[0]
            word, hidden = self.decode(joined), sum(c in LOOKS for c in joined)
            return word if self.likelihood(word) + _LOOK * hidden > self.likelihood(letters) + _KEEP * hidden else m[0]

        return _SPACED.sub(join, text)

    def chunks(self, text: str) -> list[str]:
        found = text.split()
        return self.spaced(text).split() if list(map(len, found)).count(1) else found


def units(word: str) -> list[str]:
    """What a restored word is known by: itself, and its beginnings."""
    out = []
    for w in word.split(" "):
        if len(w) > 2:
            out += [w, *(f"{w[:k]}~" for k in (5, 7) if len(w) > k)]
    return out


def _restorer(model: bytes) -> Restorer:
    return held(("restorer", model), lambda: Restorer(np.frombuffer(model).reshape(CLASSES, CLASSES, CLASSES)))


class Scorer:
    """Texts to features by a lexicon of weights."""

    def __init__(self, model: bytes, weights: dict[str, float]):
        self.restorer, self.weights = _restorer(model), weights
        self.known = Recent()

    def _weight(self, chunk: str) -> float:
        return max((self.weights.get(u, 0.0) for u in units(self.restorer.readings(chunk))), default=0.0)

    def features(self, text: str | None) -> list[float]:
        """The three strongest weights, how many words are strong, and their density."""
        chunks = self.restorer.chunks(text or "")
        self.known.add({c: self._weight(c) for c in self.known.missing(set(chunks))})
        found = sorted((w for w in map(self.known.young.__getitem__, chunks) if w), reverse=True)
        top = (found + [0.0] * 3)[:3]
        many, n = sum(found), max(10, len(chunks))
        return [top[0], top[2], math.log1p(len(found)), math.log1p(many), math.log1p(100 * many / n), math.log1p(100 * len(found) / n)]


def _fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def _signature(words: list[str]) -> str:
    """Equal for most near copies: the two runs of three words with the smallest checksums."""
    runs = {" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))}
    return "|".join(sorted(runs, key=lambda c: (zlib.crc32(c.encode()), c))[:2])


def _log_odds(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.1) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def _regression(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Coefficients of a logistic regression, the intercept last, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    keep = np.eye(x.shape[1]) * penalty
    keep[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[bytes, dict[str, float], list[float]]:
    """(language model, lexicon, coefficients) from all texts and the labels of training documents."""
    spark = docs.sparkSession
    small_batches(spark)
    model = language_model(trigram_counts(docs)).tobytes()
    own = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0
    some = F.broadcast(sampled_labels(labels, "toxic", rows, own))  # at most rows rows

    def read(x: dict[str, list]) -> dict[str, list]:
        restorer = _restorer(model)
        chunks = [restorer.chunks(t or "") for t in x["text"]]
        words = [[restorer.word(c) for c in some] for some in chunks]
        read_as = [{restorer.readings(c) for c in some} for some in chunks]
        return {"doc_id": x["doc_id"], "toxic": x["toxic"], "half": [_fold(d) // FOLDS % 2 for d in x["doc_id"]], "signature": list(map(_signature, words)), "units": [sorted({u for w in ws for u in units(w)}) for ws in read_as], "text": x["text"]}

    sample = docs.select("doc_id", "text").join(some, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), "text")
    sample = map_columns(sample, read, "doc_id long, toxic int, half int, signature string, units array<string>, text string")
    first = sample.groupBy("signature").agg(F.min("doc_id").alias("doc_id"))
    sample = sample.join(first, ["signature", "doc_id"]).dropDuplicates(["doc_id"]).persist()
    try:
        size = {(r.half, r.toxic): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
        n = {t: [size.get((h, t), 0) for h in (0, 1)] for t in (0, 1)}
        if not sum(n[0]) or not sum(n[1]):
            share = sum(n[1]) / max(1, sum(n[0]) + sum(n[1]))
            return model, {}, [0.0] * 6 + [math.log(max(share, 1e-9) / max(1 - share, 1e-9))]
        count = lambda h, t: F.count(F.when((F.col("half") == h) & (F.col("toxic") == t), 1)).alias(f"n{h}{t}")
        by_unit = sample.select("half", "toxic", F.explode("units").alias("unit")).groupBy("unit").agg(*[count(h, t) for h in (0, 1) for t in (0, 1)])
        toxic, clean = F.col("n01") + F.col("n11"), F.col("n00") + F.col("n10")
        ratio = (toxic + 0.1) / (clean + 0.5) * F.lit((sum(n[0]) + 1) / (sum(n[1]) + 1))
        found = by_unit.where((toxic >= LEAST_DOCS) & (ratio >= math.exp(LEAST_WEIGHT))).collect()  # units of LEAST_DOCS documents of the sample

        def lexicon(halves: tuple[int, ...]) -> dict[str, float]:
            add = lambda r, t: sum(r[f"n{h}{t}"] for h in halves)
            odds = {r.unit: _log_odds(add(r, 1), add(r, 0), sum(n[1][h] for h in halves), sum(n[0][h] for h in halves)) for r in found if add(r, 1) >= LEAST_DOCS}
            return {u: w for u, w in odds.items() if w >= LEAST_WEIGHT}

        apart = spark.sparkContext.broadcast([lexicon((1,)), lexicon((0,))])

        def measure(x: dict[str, list]) -> dict[str, list]:
            scorers = [Scorer(model, w) for w in apart.value]
            return {"doc_id": x["doc_id"], "toxic": x["toxic"], "x": [scorers[h].features(t) for h, t in zip(x["half"], x["text"])]}

        got = sorted(map_columns(sample.select("doc_id", "toxic", "half", "text"), measure, "doc_id long, toxic int, x array<double>").collect())
    finally:
        sample.unpersist()
    w = _regression(np.array([r.x for r in got]), np.array([r.toxic for r in got], float))
    return model, lexicon((0, 1)), w.tolist()


def score(docs: DataFrame, model: tuple[bytes, dict[str, float], list[float]], text: str = "text") -> DataFrame:
    """docs with a struct column, named by ``score_column``, of score and predicted."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the sample's weights and CLASSES ** 3 numbers
    state: dict[str, Scorer] = {}

    def fn(texts: list) -> dict[str, list]:
        lm, weights, w = shared.value
        if "scorer" not in state:
            state["scorer"] = Scorer(lm, weights)
        x = np.array([state["scorer"].features(t) for t in texts]).reshape(-1, len(w) - 1)
        p = 1 / (1 + np.exp(-np.clip(x @ np.array(w[:-1]) + w[-1], -30, 30)))
        return {"score": p.tolist(), "predicted": (p >= 0.5).astype(int).tolist()}

    return docs.withColumn(score_column(docs), text_udf(fn, "score double, predicted int")(text))


def score_column(docs: DataFrame) -> str:
    return fresh_name(docs, "toxicity")
