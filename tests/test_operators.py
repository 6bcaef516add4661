"""Operators against small models in plain Python."""

import random
from collections import deque

import numpy as np
from pyspark.sql import functions as F

from resona.functions import text as tx
from resona.functions import vectors as vx
from resona.operators import encode, evaluate as ev
from resona.operators import graph as gr
from resona.operators import plasticity as pl
from resona.operators import resonate as rs


def _bind(a, b):
    return np.real(np.fft.ifft(np.fft.fft(a) * np.fft.fft(b)))


def _unbind(c, k):
    return _bind(c, np.concatenate([k[:1], k[:0:-1]]))


def test_multihop_equals_hops_one_by_one(spark):
    rng = np.random.default_rng(5)
    d, n = 32, 40
    v = rng.standard_normal((n, d))
    mag = np.where(np.arange(n) % 7 == 0, 0.0, 1.0)
    region = (v * mag[:, None]).sum(axis=0) + 3 * _bind(v[1], v[2])
    q = v[1] + 0.5 * v[5]

    def resonate(s, k):
        score = [(float(np.dot(s, v[i]) / np.linalg.norm(s) / np.linalg.norm(v[i]) * mag[i]), i) for i in range(n) if mag[i] > 0]
        return sorted((x for x in score if x[0] > 0.05), key=lambda x: (-x[0], x[1]))[:k]

    total, s = {}, q
    for hop in range(3):
        found = resonate(s, 10)
        for x, i in found:
            total[i] = total.get(i, 0) + x * 0.7**hop
        if hop < 2:
            for _, i in found[:3]:
                g = _unbind(region, v[i])
                for x, j in resonate(g / np.linalg.norm(g), 5):
                    if j != i:
                        total[j] = total.get(j, 0) + x * 0.3 * 0.7**hop
        s = sum(v[i] for _, i in found[:5])
        s = s / np.linalg.norm(s)
    want = sorted(total.items(), key=lambda x: -x[1])[:10]
    glyphs = spark.createDataFrame([(str(i), v[i].tolist(), float(mag[i]), i) for i in range(n)], "id string, vector array<double>, magnitude double, seq long")
    got = rs.multihop(glyphs, spark.createDataFrame([("q", q.tolist())], "query_id string, vector array<double>"), spark.createDataFrame([(region.tolist(),)], "vector array<double>")).orderBy("rank").collect()
    assert [int(r.id) for r in got] == [i for i, _ in want]
    assert np.allclose([r.score for r in got], [x for _, x in want])


def test_few_and_many_queries_hop_alike(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((120, 24))
    glyphs = spark.createDataFrame([(f"g{i}", v[i].tolist(), float(i % 5 > 0), i) for i in range(120)], "id string, vector array<double>, magnitude double, seq long").repartition(3)
    stimuli = spark.createDataFrame([(f"q{k}", (v[k] + rng.standard_normal(24)).tolist()) for k in range(12)] + [("zero", [0.0] * 24)], "query_id string, vector array<double>")
    region = spark.createDataFrame([((v.sum(axis=0) + _bind(v[1], v[2])).tolist(),)], "vector array<double>")
    for bound in (region, None):
        got = []
        for held in (1 << 30, 0):
            monkeypatch.setattr(rs, "HELD", held)
            got.append({(r.query_id, r["rank"]): (r.id, round(r.score, 9), r.seq) for r in rs.multihop(glyphs, stimuli, bound, 3, 7).collect()})
        assert got[0] == got[1] and len(got[0]) == 84
    monkeypatch.setattr(rs, "HELD", 1 << 30)
    assert rs.multihop(glyphs, stimuli.where("query_id = 'zero'"), region).count() == 0 and rs.multihop(glyphs.limit(0), stimuli, region).count() == 0


def _spread(edges, stimuli, energy=1.0, decay=0.6, least=0.1, hops=4):
    out, queue, seen, used, act = {}, deque((s, energy, 0) for s in stimuli), set(), set(), {}
    for a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    while queue:
        node, e, hop = queue.popleft()
        if e < least or hop > hops:
            continue
        act[node] = act.get(node, 0) + e
        for b, w in out.get(node, []):
            if (node, b) in seen:
                continue
            seen.add((node, b))
            if e * w * decay >= least:
                used.add((node, b))
                queue.append((b, e * w * decay, hop + 1))
    return act, used


def test_spreading_equals_a_queue(spark):
    rnd = random.Random(3)
    for _ in range(3):
        pairs = list({(a, b) for a, b in ((f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}") for _ in range(30)) if a != b})
        edges = [(a, b, round(rnd.uniform(0.2, 1), 3)) for a, b in pairs]
        stimuli = ["n0", "n1", "n0"]
        act, used = _spread(edges, stimuli)
        e = spark.createDataFrame([(a, b, w, k) for k, (a, b, w) in enumerate(edges)], "src string, dst string, weight double, seq long")
        s = spark.createDataFrame([("q", n, k) for k, n in enumerate(stimuli)], "query_id string, node string, seq long")
        got, went = gr.spread(e, s)
        assert {r.node: round(r.activation, 9) for r in got.collect()} == {k: round(v, 9) for k, v in act.items()}
        assert {(r.src, r.dst) for r in went.collect()} == used


def test_vectors(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((2, 1024)) / 32
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    r = df.select(vx.bind(F.col("a"), F.col("b")).alias("ab"), vx.involution(vx.involution(F.col("a"))).alias("aa"), vx.resize(F.col("a"), 2000).alias("long"))
    r = r.withColumn("back", vx.unbind(F.col("ab"), F.lit(a.tolist()))).first()
    assert np.allclose(r.ab, _bind(a, b)) and np.allclose(r.aa, a) and len(r.long) == 2000
    back = np.array(r.back)
    assert 0.6 < back @ b / np.linalg.norm(back) / np.linalg.norm(b) < 0.8
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert zero.select(vx.cosine(F.col("a"), F.col("b")), vx.normalize(F.col("a"))).first()[:] == (0.0, [0.0, 0.0])


def test_encoding_is_the_weighted_sum_of_features(spark):
    texts = spark.createDataFrame([("x", "Deploy the qty api"), ("y", "???"), ("z", "qty")], "k string, t string")
    got = {r.k: np.array(r.vector) for r in encode.encode_text(texts, "k", "t", 64).collect()}
    assert set(got) == {"x", "y", "z"} and all(abs(np.linalg.norm(v) - 1) < 1e-9 for v in got.values())
    import hashlib

    draw = lambda f: (lambda v: v / np.linalg.norm(v))(np.random.default_rng(int(hashlib.sha256(f.encode()).hexdigest()[:16], 16)).standard_normal(64))
    assert np.allclose(got["y"], draw("???"))
    f = [r for r in encode.features(texts, "k", "t").where("k = 'z'").collect()]
    want = sum(draw(r.feature) * r.weight for r in f)
    assert np.allclose(got["z"], want / np.linalg.norm(want))
    assert {r.feature: r.weight for r in f}["quantity"] == 0.5 and {r.feature: r.weight for r in f}["qty"] == 1.0
    again = {r.k: np.array(r.vector) for r in encode.encode_text(texts.repartition(7), "k", "t", 64).collect()}
    assert all(np.allclose(got[k], again[k]) for k in got)


def test_unit_vectors_are_numpys_without_a_generator_for_each(monkeypatch):
    seeds = [0, 1, 2**32 - 1, 2**32, 2**63, 2**64 - 1, *map(random.Random(3).getrandbits, [64] * 300)]
    want = [(lambda v: v / np.linalg.norm(v))(np.random.default_rng(s).standard_normal(33)) for s in seeds]
    monkeypatch.setattr(np.random, "default_rng", None)
    assert np.array_equal(vx.unit_vectors(np.array(seeds, np.uint64), 33), want)
    assert vx.unit_vectors(np.empty(0, np.uint64), 33).shape == (0, 33)


def test_projection_of_frequent_and_rare_features(monkeypatch):
    import pyarrow as pa

    for name, n in (("SEEDS", 8), ("ROWS", 16), ("PART", 50), ("SPARSE", 4), ("CACHE", 16)):
        monkeypatch.setattr(encode, name, n)
    rnd = random.Random(4)
    rows = [[rnd.randrange(6) if rnd.random() < 0.7 else rnd.randrange(-(2**63), 2**63) for _ in range(rnd.randrange(9))] for _ in range(130)]
    weights = [[rnd.choice([0.08, 0.5, 1.0]) for _ in r] for r in rows]
    got = encode.projection(24).func(pa.array(rows, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.float64())))
    for v, r, w in zip(np.array(got.to_pylist()), rows, weights):
        want = sum((x * vx.unit_vectors(np.array([s % 2**64], np.uint64), 24)[0] for s, x in zip(r, w)), np.zeros(24))
        assert np.allclose(v, want / (np.linalg.norm(want) or 1.0))


def test_connecting_shuffles_a_pair_once(spark):
    rnd = random.Random(8)
    name = lambda: rnd.choice(["a", "b", "B", "é", "", None])
    rows = [(k, name(), name(), rnd.choice([0.05, 0.3, 0.9, None])) for k in rnd.sample(range(1000), 150)]
    pairs = spark.createDataFrame(rows, "seq long, a string, b string, weight double")
    found: dict = {}
    for k, a, b, w in sorted(rows, key=lambda r: r[0]):
        for s, edge, x in ((2 * k, (a, b), w), (2 * k + 1, (b, a), None if w is None else w * 0.8)):
            found.setdefault(edge, []).append((s, x))
    want = {e: (1.0 if x[0][1] is None else min(1.0, x[0][1] + 0.1 * (len(x) - 1)), x[0][0]) for e, x in found.items()}
    got = gr.connect(pairs)
    assert {(r.src, r.dst): (r.weight, r.seq) for r in got.collect()} == want and got.count() == len(want)
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_spreading_makes_its_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def weight(w):
        made.add(1)
        return w

    pairs = [("a", "b", 1.0, 0), ("b", "c", 0.9, 1), ("c", "a", 0.8, 2), ("a", "d", 0.166, 3), ("a", "e", 0.1 / 0.6, 4), ("c", "d", 0.5, 5)]
    edges = spark.createDataFrame(pairs, "src string, dst string, weight double, seq long")
    stimuli = spark.createDataFrame([(1, "a", 0)], "query_id long, node string, seq long")
    want = {(r.node, r.activation) for r in gr.spread(edges, stimuli)[0].collect()}
    got = gr.spread(edges.repartition(2).withColumn("weight", weight.asNondeterministic()("weight")), stimuli, most=1.0)[0]
    assert {(r.node, r.activation) for r in got.collect()} == want and made.value == len(pairs)
    # weights by which energy grows: nothing is left out
    loud = edges.unionByName(spark.createDataFrame([("a", "x", 20.0, 6), ("x", "y", 0.05, 7)], edges.schema))
    assert {r.node for r in gr.spread(loud, stimuli, most=20.0)[0].collect()} >= {"x", "y"}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.identifier_words(F.lit("parseHTTPRequest_fast-path"))) == ["parse", "request", "fast", "path"]
    assert one(tx.tokens(F.lit("Élan vital, a b2 C"))) == ["lan", "vital", "b2"]
    assert [one(tx.stem(F.lit(w))) for w in ("authentication", "deployment", "ring", "ties", "edges")] == ["authentic", "deploy", "ring", "ties", "edg"]
    assert one(tx.bigrams(F.array(F.lit("one")))) == [] and one(tx.trigrams(F.array(F.lit("ab")))) == []
    assert one(tx.trigrams(F.array(F.lit("ab"), F.lit("c1d")))) == ["abc"]
    assert one(tx.path_stem(F.lit("a/.env"))) == ".env" and one(tx.path_suffix(F.lit("a/.env"))) == ""
    assert one(tx.seed(F.lit("x"))) == int(__import__("hashlib").sha256(b"x").hexdigest()[:16], 16)


def test_plasticity(spark):
    schema = "id string, vector array<double>, magnitude double, created_at double, last_activated double, activation_count long, source string, content string, region_id string, seq long"
    row = lambda i, x, seq, src="", text="": (i, [x], 1.0, 0.0, 0.0, 0, src, text, "default", seq)
    old, new = spark.createDataFrame([row("a", 1.0, 0, "s", "old")], schema), spark.createDataFrame([row("a", 2.0, 1), row("b", 5.0, 2, "t"), row("a", 4.0, 3, "", "new")], schema)
    got = {r.id: r for r in pl.upsert(old, new).collect()}
    assert got["a"].vector == [4.0] and got["a"].source == "s" and got["a"].content == "new" and got["a"].seq == 0 and got["b"].vector == [5.0]
    assert pl.regions(pl.ledger_of(old, new)).first().vector == [-1.0 + 4.0 + 5.0]  # the old glyph's own row is in the ledger already
    log = spark.createDataFrame([(9.0, "a", 0.7), (8.0, "a", 0.7)], "ts double, id string, amount double")
    r = pl.reinforce(old, log).first()
    assert r.magnitude == 2.0 and r.activation_count == 2 and r.last_activated == 9.0
    gone = pl.decay(old, 1e9, 1.0)
    assert pl.forget_summary(old, gone).first()[:] == (1, 1, 0, 1) and pl.forget_summary(gone, gone).first()[:] == (0, 1, -1, 0)


def test_metrics(spark):
    judged = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False)], "query_id string, rank int, relevant boolean")
    assert ev.mrr(judged).first()[0] == 0.25
    assert abs(ev.ndcg(judged).first()[0] - (1 / np.log2(3)) / 2) < 1e-12
    assert ev.precision(judged).first()[0] == 0.25
    values = spark.createDataFrame([(float(x),) for x in [5, 1, 4, 2, 3, 3, 3, 9, 8, 7]], "x double")
    s = sorted([5, 1, 4, 2, 3, 3, 3, 9, 8, 7])
    assert ev.percentile_at(values, "x", {"p50": 0.5, "p95": 0.95}).first()[:] == (s[5], s[9])


def test_distill_reads_every_turn_whole(spark):
    from resona.plans import catalogue

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    got = {r.source: r.intention for r in catalogue.QUERIES["distill"](spark, sf).collect()}
    assert len({r.turn for r in rows}) > 1 and got == {f"{r.conv_id}_{r.turn}": r.text for r in rows}


def test_words_of_many_queries_are_looked_for_in_several_lists(spark, monkeypatch):
    rnd = random.Random(4)
    words = [f"w{k}x" for k in range(60)] + ["x", "w1"]
    docs = [(k, " ".join(rnd.choice(words).upper() for _ in range(rnd.randrange(30)))) for k in range(40)]
    queries = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 9)))) for k in range(20)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string")
    got = []
    for sent in (10_000, 7):
        monkeypatch.setattr(ev, "SENT", sent)
        got.append({(r.query_id, r.doc_id, r.score) for r in ev.substring_topk(d, q, 100).collect()})
    want = {(i, k, n) for i, t in queries for k, text in docs if (n := sum(w in text.lower() for w in set(t.split())))}
    assert got == [want, want]


def test_containment_equals_comparing_all(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("ab") for _ in range(rnd.randrange(14)))
    left, right = [word() for _ in range(60)], [word() for _ in range(80)]
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    found = gr.contained(frame(left, "word"), frame(right, "other"))
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(a, b) for a in left for b in right if a in b or b in a}
    queries = spark.createDataFrame([(1, "Pay-the invoice_now"), (2, "xy")], "query_id long, query string")
    nodes = spark.createDataFrame([("payment_rule", 1), ("_odd", 2), ("voice", 3), ("zz", 4)], "id string, seq long")
    named = gr.named_nodes(queries, nodes)
    plan = named._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {(r.query_id, r.node) for r in named.collect()} == {(1, "payment_rule"), (1, "_odd"), (1, "voice")}


def test_the_comment_above_is_found_in_one_pass(spark):
    import time

    from resona.sources import structure

    texts = ["", "def a", "/** Says it. */\n\n  \nfunction one(a) {}\n// two\nfunction two() {}" + " " * 3000 + "\nfunction far() {}"]
    texts.append("".join(f"// comment {k}\nfunction f{k}(a, b) {{ return {k} }}\n" for k in range(2000)))
    pattern = structure.LANGUAGES[0][2][0][1]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    began = time.time()
    got = {r.k: r.b for r in d.select("k", structure._before(F.col("text"), pattern).alias("b")).collect()}
    assert time.time() - began < 30 and len(got[3]) == 2000
    import re as regex

    for k, t in enumerate(texts):
        assert got[k] == [t[: m.start()].rstrip(" \t\n\x0b\f\r")[-500:] for m in regex.finditer(pattern, t)]


def test_fallback_keeps_what_results_push_out(spark):
    g = spark.createDataFrame([(f"g{k}", "alpha beta" if k % 2 else "alpha", 1.0 + k % 3, k) for k in range(30)], "id string, content string, magnitude double, seq long")
    q = spark.createDataFrame([("q", "alpha beta")], "query_id string, query string")
    score = lambda k: (2 if k % 2 else 1) / 2 * rs.FALLBACK * (1.0 + k % 3)
    best = sorted(range(30), key=lambda k: (-score(k), k))
    own = spark.createDataFrame([("q", f"g{k}", 5.0 - n, k, n + 1) for n, k in enumerate(best[:4])], "query_id string, id string, score double, seq long, rank int")
    got = [r.id for r in rs.with_fallback(own, g, q, 7).orderBy("rank").collect()]
    assert got == [f"g{k}" for k in best[:7]]


def test_words_within_words_are_looked_up_once_for_repeated_and_odd_rows(spark, monkeypatch):
    docs = [(1, "Alpha beta"), (1, "alphabet x"), (2, None), (None, "beta"), (None, "BETA alp"), (3, ""), (4, "x\tbeta\nalp"), (5, "beta alp")]
    queries = [(7, "alp beta beta"), (7, "alp"), (8, "t x ALPHA"), (9, None), (10, "zzz")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, query string")
    monkeypatch.setattr(ev, "SCORED", 1)
    few = ev.substring_topk(d, q, 3)
    assert "contains(" not in few._jdf.queryExecution().optimizedPlan().toString().lower()  # no list of all words goes with each document
    found = {(r.query_id, r.doc_id, r.score, r["rank"]) for r in few.collect()}
    monkeypatch.setattr(ev, "SENT", 2)
    assert found == {(r.query_id, r.doc_id, r.score, r["rank"]) for r in ev.substring_topk(d, q, 3).collect()}
    assert found == {(7, 1, 5, 1), (7, None, 4, 2), (7, 4, 3, 3), (8, 1, 3, 1)}
    assert ev.substring_topk(d, q.limit(0)).count() == 0


def test_features_of_a_key_are_counted_where_its_texts_are(spark):
    rows = [("a", "The ctx CTX ctxs running"), ("a", "ctx of ctx"), ("b", None), (None, "Zürich x9 x9"), ("c", "?!"), ("d", "")]
    texts = spark.createDataFrame(rows, "k string, t string")
    found = encode.features(texts, "k", "t")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan  # no row for each occurrence
    got = {(r.k, r.feature): round(r.weight, 6) for r in found.collect()}
    groups = {"ctx": ["context"]}
    one, two = (encode.text_features(t, groups) for _, t in rows[:2])
    single = ("the", "ctx", "ctxs", "running", "runn", "context", "of")
    want = {("a", f): round(max(one.get(f, 0), two.get(f, 0)) if f in single else one.get(f, 0) + two.get(f, 0), 6) for f in {*one, *two}}
    assert got == want | {(None, f): round(w, 6) for f, w in encode.text_features(rows[3][1], groups).items()}
    assert {r.k for r in encode.encode_text(texts, "k", "t", 16).collect()} == {"a", None, "c", "d"}


def test_binding_makes_no_object_for_each_vector(spark):
    rows = [([float(k), 1.0, -2.0, 0.5], [0.25, float(-k), 3.0, 1.0]) for k in range(1300)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>").repartition(1)
    for r in df.select("a", "b", vx.bind(F.col("a"), F.col("b")).alias("ab")).collect():
        assert np.allclose(r.ab, [sum(r.a[j] * r.b[(i - j) % 4] for j in range(4)) for i in range(4)])
    assert "ArrowEvalPython" in df.select(vx.bind(F.col("a"), F.col("b")))._jdf.queryExecution().executedPlan().toString()
    assert df.limit(0).select(vx.bind(F.col("a"), F.col("b"))).count() == 0


def test_texts_of_a_key_are_encoded_beside_each_other(spark):
    rows = [("a", "Deploy ctx", "deployUnit"), ("b", None, "qty"), ("a", None, "x9"), (None, "???", None), ("c", None, None), ("d", "", "api_key"), ("a", "ctx again", None)]
    texts = spark.createDataFrame(rows, "k string, t string, n string").repartition(3)
    both = encode.encode_text(texts, "k", "t", 32, beside={"w": "n"})
    got = {r.k: (r.vector, r.w) for r in both.collect()}
    assert both.columns == ["k", "vector", "w"] and set(got) == {"a", "b", None, "d"}
    for at, column in enumerate(("t", "n")):
        want = {r.k: r.vector for r in encode.encode_text(texts, "k", column, 32).collect()}
        assert {k for k, v in got.items() if v[at] is not None} == set(want)
        assert all(np.allclose(got[k][at], v) for k, v in want.items())
    named = {r.k: r for r in encode.encode_identifier(texts, "k", "n", None, 32, {"text": "t", "as_it_is": "n"}).collect()}
    assert np.allclose(named["a"].text, got["a"][0]) and np.allclose(named["d"].vector, [r.vector for r in encode.encode_text(spark.createDataFrame([("d", "api key")], "k string, t string"), "k", "t", 32).collect()])
    assert np.allclose(named["b"].as_it_is, got["b"][1]) and named["b"].text is None and texts.limit(0).count() == encode.encode_text(texts.limit(0), "k", "t", 8, beside={"w": "n"}).count()


def test_identifiers_are_encoded_without_a_join_of_vectors(spark):
    from resona.plans import vector_queries as vq

    found = vq.encode_identifiers(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # texts are dealt once, vectors stay where they are made
    assert {r.cosine for r in found.collect()} == {1.0} and found.count() == spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
