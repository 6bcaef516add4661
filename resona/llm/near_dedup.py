"""Near duplicates by fast similarity sketching, banding and exact verification.

A document's set is its distinct five-word shingles, as 64-bit fingerprints.

Sketch: in round i every element goes to a hashed bin of ``BINS`` with a
value of i and a hash; in rounds BINS to 2*BINS - 1 every element goes to bin
i - BINS. A bin keeps its least value, and the rounds of a document end once
all its bins are filled, which the second half guarantees. Two sets agree in
each bin with the probability of their similarity, sharply concentrated.

Bands of bins give bucket keys, of as many bins as ``band_rows`` says: a pair at
the threshold misses all its buckets with a probability below ``MISS`` (bands of 5
bins at similarity 0.85, of 4 at 0.80).

1. Documents with the same set are one class, of the smallest doc_id.
2. A bucket is never expanded into its pairs. First its pivot meets the members:
   the one that shares most with others (all members, of a bucket of ``PIVOTS``).
   Members of buckets that are then not all connected are paired by an exact
   prefix filter: with shingles in order of rarity among them, similar sets share
   one among their first ones, at places that leave room for enough common ones
   after it. Copies that differ by too many words of their own share none
   there. Of a shingle's members those of its largest component only meet the
   others. Every pair of a bucket is so verified, connected or ruled out:
   nothing is capped.
3. Candidates are verified on full sets, joined by class.
4. Components of the verified links take the smallest label of their
   neighbours, with pointer jumping, until nothing changes.

Null and empty texts, and texts without words, have no shingles and are linked
with nothing: they are their own component. Rows with a null doc_id take no
part: their component is null and they are kept. Rows that share a doc_id are
one document; of different texts under one doc_id, the one whose fingerprints
come first is verified. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import broadcast_if_small, map_columns, written

WORDS = 5
BINS, MISS = 125, 1e-6
PIVOTS = 8
#: Elements whose bins are filled at once; a larger set is filled alone.
ELEMENTS = 1 << 18
#: Links have 100 * intersection >= percent * union; the percentage of op7's contract.
PERCENT = 85

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLY = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MULTIPLY[0]
    x = (x ^ (x >> np.uint64(27))) * _MULTIPLY[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted fingerprints of the text's distinct shingles."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    acc = np.full(n, len(h) if len(h) < WORDS else WORDS, np.uint64)
    for k in range(min(WORDS, len(h))):
        acc = mix(acc * _STEP + h[k : k + n])
    return np.unique(acc)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS values per set; none of the sets is empty."""
    groups: list[list[np.ndarray]] = [[]]
    size = 0
    for s in sets:
        if groups[-1] and size + len(s) > ELEMENTS:
            groups.append([])
            size = 0
        groups[-1].append(s)
        size += len(s)
    return np.concatenate([_filled(g) for g in groups])


def _filled(sets: list[np.ndarray]) -> np.ndarray:
    rows = len(sets)
    sizes = np.array([len(s) for s in sets])
    out = np.full(rows * BINS, np.iinfo(np.uint64).max, np.uint64)
    elements = np.concatenate(sets) if rows else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(rows), sizes)
    low = np.uint64((1 << 56) - 1)
    for i in range(2 * BINS):
        if not len(elements):
            break
        h = mix(elements + np.uint64((i + 1) * int(_STEP) % 2**64))
        at = (mix(h ^ _STEP) % np.uint64(BINS)).astype(np.int64) if i < BINS else i - BINS
        np.minimum.at(out, owner * BINS + at, (np.uint64(i) << np.uint64(56)) | (h & low))
        open_rows = (out.reshape(rows, BINS) == np.iinfo(np.uint64).max).any(axis=1)
        go_on = open_rows[owner]
        if not go_on.all():
            elements, owner = elements[go_on], owner[go_on]
    return out.reshape(rows, BINS)


def missed(percent: int, rows: int) -> float:
    """The probability that a pair of this similarity shares no bucket of bands of so many bins."""
    return (1 - (percent / 100) ** rows) ** (BINS // rows)


def band_rows(percent: int) -> int:
    """The most bins a band may have for the threshold."""
    return max((r for r in range(1, BINS) if missed(percent, r) < MISS), default=1)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A row of bucket keys per sketch, one for each band of so many bins."""
    n = BINS // rows
    parts = sketch[:, : n * rows].reshape(len(sketch), n, rows)
    key = np.broadcast_to(np.arange(n, dtype=np.uint64), (len(sketch), n)).copy()
    for k in range(rows):
        key = mix(key * _STEP + parts[:, :, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """id, n_shingles, digest (of the set) and bands (null without shingles)."""
    rows = band_rows(percent)

    def fn(x: dict[str, list]) -> dict[str, list]:
        sets = [shingles(t) for t in x["text"]]
        full = [s for s in sets if len(s)]
        keys = iter(bands(sketches(full), rows))
        digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return {"id": x["id"], "n_shingles": [len(s) for s in sets], "digest": digest, "bands": [next(keys) if len(s) else None for s in sets]}

    return map_columns(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), fn, "id long, n_shingles long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """class and shingles of docs with class and text."""

    def fn(x: dict[str, list]) -> dict[str, list]:
        return {"class": x["class"], "shingles": [shingles(t).view(np.int64) for t in x["text"]]}

    return map_columns(docs.select("class", "text"), fn, "class long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * union).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node and component, the smallest node that it reaches over links (a, b), for every node of a link."""
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = edges.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("node"), F.least("a", "near").alias("component"))
    labels = written(labels, "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("beyond"))
        new = written(lower.join(jump, "to").select("node", "was", F.col("beyond").alias("component")), "labels")
        labels = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return labels


def _unconnected(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets in which more than one component is left, with their components."""
    found = members.drop("component").join(labels, members["class"] == labels["node"], "left").select("key", "class", "n", F.coalesce("component", "class").alias("component"))
    spread = found.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("key")
    return found.join(broadcast_if_small(written(spread, "spread")), "key", "left_semi")


def _with_pivots(members: DataFrame) -> DataFrame:
    """members with pivot: all of a bucket of no more than ``PIVOTS``, else the member that shares most
    with others over all its buckets; the text that a family of copies was made from is often that one.
    """
    # what is joined by bucket has a row or a few per bucket: broadcast while small, so that no large bucket is one task
    sizes = written(members.groupBy("key").agg(F.count("*").alias("size")), "sizes")
    sized = members.join(broadcast_if_small(sizes), "key")
    weight = sized.groupBy("class").agg(F.sum("size").alias("weight"))
    weighed = sized.join(weight, "class")
    first = weighed.groupBy("key").agg(F.max(F.struct(F.col("weight"), -F.col("class"))).alias("m")).select("key", (-F.col("m.col2")).alias("first"))
    return weighed.join(broadcast_if_small(written(first, "first")), "key").withColumn("pivot", (F.col("size") <= PIVOTS) | (F.col("class") == F.col("first"))).select("key", "class", "n", "component", "pivot")


def _pairs(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of a bucket's pivots with its members, unless their sizes rule a link out."""
    p = members.where("pivot").select("key", F.col("class").alias("p"), F.col("n").alias("pn"))
    fits = (F.col("class") != F.col("p")) & (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn"))
    p = broadcast_if_small(written(p, "pivots"))
    return members.join(p, (members["key"] == p["key"]) & fits).select(F.least("class", "p").alias("a"), F.greatest("class", "p").alias("b")).distinct()


def _prefixes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """token, class, n, component and place of each member's rarest shingles, so many that similar sets share one."""
    left = members.select("class", "component").distinct()
    each = sets.join(left, "class").select("class", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    rarity = written(each.groupBy("token").agg(F.count("*").alias("times")), "rarity")  # a table, so that Spark can split a common token in the join
    in_order = each.join(rarity, "token").groupBy("class", "component", "n").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("tokens"))
    first = F.slice("tokens", F.lit(1), F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)
    return in_order.select("class", "component", "n", F.posexplode(first).alias("place", "t")).where("t.times > 1").select(F.col("t.token").alias("token"), "class", "n", "component", "place")


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of members of different components that the prefix filter leaves."""
    found = written(_prefixes(members, sets, percent), "prefixes")
    counts = found.groupBy("token", "component").agg(F.count("*").alias("size"))
    largest = counts.groupBy("token").agg(F.max(F.struct("size", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("token", F.col("m.component").alias("largest"))
    # as with buckets, what joins by token is broadcast while small
    largest = broadcast_if_small(written(largest, "largest"))
    p = found.join(largest, "token").where(F.col("component") != F.col("largest"))
    p = p.select("token", F.col("class").alias("p"), F.col("n").alias("pn"), F.col("component").alias("pc"), F.col("place").alias("pp"))
    p = broadcast_if_small(written(p, "others"))
    # so many may be common from these places on; similar sets need so many of both
    fits = (F.col("component") != F.col("pc")) & ((100 + percent) * F.least(F.col("n") - F.col("place"), F.col("pn") - F.col("pp")) >= percent * (F.col("n") + F.col("pn")))
    return found.join(p, (found["token"] == p["token"]) & fits).select(F.least("class", "p").alias("a"), F.greatest("class", "p").alias("b")).distinct()


def link_classes(docs: DataFrame, classes: DataFrame, key: str, text: str, percent: int) -> DataFrame | None:
    """Components of classes (class, n, bands) that have verified links; None without any."""
    keyed = classes.select("class", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1").select("key")
    members = written(keyed.join(shared, "key", "left_semi").select("key", "class", "n", F.col("class").alias("component")), "buckets")
    if members.isEmpty():
        return None
    wanted = broadcast_if_small(members.select(F.col("class").alias("wanted")).distinct())
    texts = docs.select(F.col(key).cast("long").alias("class"), F.col(text).alias("text")).join(wanted, F.col("class") == F.col("wanted"), "left_semi")
    sets = written(shingle_sets(texts).groupBy("class").agg(F.min("shingles").alias("shingles")), "sets")
    marked = written(_with_pivots(members), "pivots")
    links = written(verified(_pairs(marked, percent), sets, percent), "links")
    labels = components(links)
    rest = written(_unconnected(marked.where(~F.col("pivot")).drop("pivot"), labels), "buckets")
    if rest.isEmpty():
        return labels
    more = written(verified(_prefix_pairs(rest, sets, percent), sets, percent), "links")
    return labels if more.isEmpty() else components(links.unionByName(more))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the component's own document), a row per row of docs."""
    found = written(signatures(docs, key, text, percent), "signatures")
    sets = found.where("digest is not null and id is not null")
    classes = written(sets.groupBy("digest").agg(F.min("id").alias("class"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    labels = link_classes(docs, classes, key, text, percent)
    component = classes.select("digest", "class")
    if labels is not None:
        component = component.join(labels, component["class"] == labels["node"], "left").select("digest", F.coalesce("component", "class").alias("class"))
    named = lambda rows: rows.select(F.col("id").alias(key), "n_shingles", F.col("class").alias("component_id"))
    # what has no set or no id is linked with nothing, and would all meet in one task of a join
    alone = found.where("digest is null or id is null").select("id", "n_shingles", F.col("id").alias("class"))
    linked = sets.select("id", "n_shingles", "digest").join(component, "digest").select("id", "n_shingles", F.coalesce("class", "id").alias("class"))
    return named(linked).unionByName(named(alone)).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
