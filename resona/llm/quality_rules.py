"""Quality rules: document statistics, judged by boosted trees with monotone constraints.

The trees are fitted on at most ``SAMPLE`` labelled documents (those of the
smallest hash of doc_id), whose statistics, not texts, reach the driver. Scoring
is a numpy pass over flat node arrays. Statistics of symbols, upper case,
repeated lines, repeated windows and the commonest word may only lower a
document's score.

Words are runs of characters other than ASCII white space. A null or empty
text has no words and fails the base rule. Without usable labels the trees
give 0.5 to all and only the base rule rejects. Repeated rows are judged one
by one; labels that occur twice for a doc_id count twice.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, fit
from .common import fresh_name, sampled_labels, small_batches, text_udf

SAMPLE = 20_000
SYMBOLS = b"#*$%&|<>"
#: Documents below this probability of good quality are rejected.
LEAST = 0.5
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER, _DIGITS, _OTHER = bytes(range(65, 91)), bytes(range(48, 58)), bytes(c for c in range(33, 127) if not chr(c).isalnum())
_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"
#: How the score may change with each feature: 1 up only, -1 down only, 0 either way.
SIGNS = [0, 0, -1, -1, -1, -1, 0, 0, -1, 0, 0, 0]


def statistics(text: str | None) -> tuple[int, int, int, int, int, list[float]]:
    """The base measures, and the features that the trees use."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    dup = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(windows)) < len(windows):
        count = Counter(windows)
        covered = 0
        for at, w in enumerate(windows):
            if count[w] > 1:
                repeat += at + 3 - max(at, covered)
                covered = at + 3
    upper, digits, other = (len(raw) - len(raw.translate(None, x)) for x in (_UPPER, _DIGITS, _OTHER))
    size, some = max(1, len(raw)), max(1, n)
    top = max(Counter(words).values()) if n else 0
    ends = raw.count(b".") + raw.count(b"!") + raw.count(b"?")
    features = [
        float(np.log1p(n)), word_chars / some, symbols / some, dup / max(1, len(lines)), repeat / some, upper / size,
        digits / size, len(set(words)) / some, top / some, ends / some, len(lines) / some, other / size,
    ]
    return n, word_chars, symbols, dup, repeat, features


def _all(texts: list) -> dict[str, list]:
    return dict(zip((*_NAMES, "features"), map(list, zip(*map(statistics, texts))))) if texts else {k: [] for k in (*_NAMES, "features")}


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Forest:
    """The trees for labels.quality, from the statistics of at most so many documents."""
    small_batches(docs.sparkSession)
    some = F.broadcast(sampled_labels(labels, "quality", rows))  # at most rows rows
    measured = docs.select("doc_id", "text").join(some, "doc_id").select("doc_id", "quality", text_udf(_all, SCHEMA)("text").alias("s"))
    got = measured.select("doc_id", "quality", "s.features").collect()
    got.sort(key=lambda r: (r[0], r[1], r[2]))
    return fit(np.array([r[2] for r in got], float).reshape(-1, len(SIGNS)), np.array([r[1] for r in got], float), SIGNS)


def judge(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """docs with a struct column, named by ``verdict_column``, of the measures, score, base_failed and kept."""
    small_batches(docs.sparkSession)

    def fn(texts: list) -> dict[str, list]:
        s = _all(texts)
        score = forest.score(np.array(s.pop("features"), float).reshape(-1, len(SIGNS)))
        failed = [n < 50 or 100 * r > 50 * n for n, r in zip(s["n_words"], s["n_repeat_words"])]
        return s | {"score": score.tolist(), "base_failed": failed, "kept": [not f and p >= LEAST for f, p in zip(failed, score)]}

    udf = text_udf(fn, SCHEMA.replace("features array<double>", "score double, base_failed boolean, kept boolean"))
    return docs.withColumn(verdict_column(docs), udf(text))


def verdict_column(docs: DataFrame) -> str:
    return fresh_name(docs, "quality_verdict")
