"""Archives, vectors, toxicity and the pipeline."""

import gzip
import hashlib
import io
import math
import random
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

import corpus_pipeline
from resona.llm import toxicity, vector_search, warc_archives
from resona.llm.common import written

RND = random.Random(4)


def test_archives_round_trip(spark, tmp_path):
    long = "<p>é" + "x" * 200
    rows = [(5, "http://a/ b", long), (2, None, long), (9, "u", "short"), (8, "u", "short"), (7, "u", None), (11, "u", ""), (None, "u", long), (12, "v", "y" * 90_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0)).repartition(3)
    manifest = warc_archives.write(pages, f"file://{tmp_path}/a", archive_bytes=300)
    assert manifest.count() > 3
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_archives.read(manifest).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(k, len((t or "").encode()), sha(t or ""), "revisit" if k == 5 else "response", 2 if k == 5 else None) for k, _, t in rows}
    assert warc_archives.round_trip(pages.limit(0), f"file://{tmp_path}").count() == 0


def test_zip64_directory():
    """An archive whose sizes, offsets and counts stand in ZIP64 fields only."""
    a = warc_archives.Archive()
    a.add(1, "u", b"payload", None)
    a.add(3, "u", b"payload", 1)
    index = "\n".join(a.index).encode()
    out, central = io.BytesIO(b""), b""
    out.write(b"junk before")
    for name, body in ((b"archive/data.warc.gz", a.data.getvalue()), (b"indexes/index.cdxj", index)):
        at, wide = out.tell(), struct.pack("<HHQQ", 1, 16, len(body), len(body))
        out.write(b"PK\3\4" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide)) + name + wide + body)
        wide = struct.pack("<HHQQQ", 1, 24, len(body), len(body), at)
        central += b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + name + wide
    at = out.tell()
    out.write(central)
    end = out.tell()
    out.write(b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 2, 2, len(central), at))
    out.write(b"PK\6\7" + struct.pack("<IQI", 0, end, 1))
    out.write(b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    raw = out.getvalue()
    got = list(warc_archives.records(pa.PythonFile(io.BytesIO(raw), "r"), len(raw)))
    assert [(r["page_id"], r["record_type"], r["refers_to"], r["payload"]) for r in got] == [(1, "response", None, b"payload"), (3, "revisit", 1, None)]


def _zipped(records, index, deflated=False, name="indexes/index.cdxj"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("archive/data.warc.gz"), records, zipfile.ZIP_DEFLATED if deflated else zipfile.ZIP_STORED)
        z.writestr(zipfile.ZipInfo(name), gzip.compress(index) if name.endswith(".gz") else index, zipfile.ZIP_STORED)
    return list(warc_archives.records(pa.PythonFile(io.BytesIO(out.getvalue()), "r"), len(out.getvalue())))


def test_what_an_index_may_name(monkeypatch):
    monkeypatch.setattr(warc_archives, "READ_BYTES", 600)  # smaller than the second record
    a = warc_archives.Archive()
    payloads = {1: b"payload", 2: RND.randbytes(3000), 3: b"x" * 50}
    for k, payload in payloads.items():
        a.add(k, "u", payload, None)
    body, index = a.data.getvalue(), "\n".join(a.index).encode()
    for name in ("indexes/index.cdxj", "indexes/more.cdxj.gz", "indexes/index.cdx"):
        assert {r["page_id"]: r["payload"] for r in _zipped(body, index, name=name)} == payloads
    with pytest.raises(ValueError, match="data.warc.gz is deflated"):
        _zipped(body, index, deflated=True)
    with pytest.raises(ValueError, match="no member archive/other"):
        _zipped(body, index.replace(b"data.warc.gz", b"other.warc.gz"))


def test_revisits_are_those_of_their_response(spark):
    rows = [(1, 120, "aa", "response", None), (2, 120, "aa", "revisit", 1), (3, 120, "aa", "revisit", 1), (4, 7, "bb", "response", None)]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    assert warc_archives.checked(spark.createDataFrame(rows, schema)).count() == 4
    for bad in ((5, 120, "ab", "revisit", 1), (5, 121, "aa", "revisit", 1), (5, 120, "aa", "revisit", 9), (5, 120, "aa", "revisit", 2)):
        with pytest.raises(ValueError, match="is not the response"):
            warc_archives.checked(spark.createDataFrame([*rows, bad], schema))


@pytest.mark.parametrize("scale", [1.0, 25.0])
def test_vector_search(spark, scale):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:180] = x[100]  # equal vectors
    x[200:240] = x[200] + rng.normal(0, 0.01, (40, 16))
    x *= np.linspace(1, scale, 600)[:, None] if scale > 1 else 1
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [math.nan] + [1.0] * 15), (1003, [math.inf] * 16), (1004, [None] + [1.0] * 15), (1005, [1.0]), (None, [1.0] * 16), (0, rows[0][1])]
    d = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("point", F.lit("x")).repartition(3)
    got = {}
    for r in vector_search.search(d, d.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    assert set(got) == {k for k in range(600) if k % 20 == 0}
    for q, found in got.items():
        s = x @ x[q]
        want = sorted((k for k in range(600) if k != q), key=lambda k: (-s[k], k))[:20]
        found.sort()
        assert [a for a, _, _ in found] == list(range(1, 21)) and all(abs(s[b] - c) < 1e-9 * max(1, abs(c)) for _, b, c in found)
        if scale == 1.0 and q in range(100, 180):
            assert [b for _, b, _ in found] == [k for k in range(100, 122) if k != q][:20]
        hit, total = hit + len(set(want) & {b for _, b, _ in found}), total + 20
    assert hit / total >= 0.9
    few = vector_search.search(d.where("vec_id < 5"), d.where("vec_id = 0"), 20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert vector_search.search(d.limit(0), d.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 10, 21])
def test_no_query_is_left_with_too_few(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 12))
    x[1::2] = -x[: n - n % 2 : 2][: len(x[1::2])] * 40  # opposite vectors, of very different lengths
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vector_search.search(d, d, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    for q in range(n):
        s = x @ x[q]
        assert [v for _, v in sorted(got[q])] == sorted((k for k in range(n) if k != q), key=lambda k: (-s[k], k))[:20]


def test_queries_of_one_bucket_meet_in_groups(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 16)
    monkeypatch.setattr(vector_search, "GROUP", 16)
    seen, cogroup = [], GroupedData.cogroup
    monkeypatch.setattr(GroupedData, "cogroup", lambda left, right: seen.extend([left, right]) or cogroup(left, right))
    x = np.random.default_rng(4).normal(1, 0.001, (400, 8))  # all visit the same buckets
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    for r in vector_search.search(d, d, 5).where("rank = 1").collect():
        assert abs(r.score - s[r.query_id].max()) < 1e-9
    assert len(seen) == 2 and all(max(r["count"] for r in g.count().collect()) < 60 for g in seen)


def test_clusters_are_told_apart():
    """Where there is something to find, less than a fifth of the points is compared, none twice, at a recall of 0.9."""
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((100, 1, 32)) + 0.1 * rng.standard_normal((100, 60, 32))).reshape(-1, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[::20]
    index = vector_search.fit(x[rng.permutation(len(x))[:2000]], np.linalg.norm(x, axis=1).max(), 10)
    s = vector_search.compared(q, index.own(q), index.visits(q), x, index.slots(x))
    whole = q @ x.T
    made = s > -np.inf
    assert np.allclose(s[made], whole[made]) and made.mean() < 0.2
    keys, success = index.probes(q)  # the same buckets, as probed one by one in order
    for n in range(0, len(q), 37):
        want = np.zeros(len(x), bool)
        for t in range(vector_search.TABLES):
            last = int(np.searchsorted(success[n, t], index.share)) + 1
            want |= np.isin(vector_search.pack(index.slots(x))[:, t], keys[n, t, :last])
        assert (made[n] == want).all()
    top = lambda m: np.argsort(-m, axis=1)[:, :11]
    assert np.mean([len(set(a) & set(b)) / 11 for a, b in zip(top(s), top(whole))]) >= 0.9


def test_blocks_of_buckets():
    assert vector_search._blocks([(1, 4), (2, 6), (3, 1), (4, 25), (5, 2), (6, 9)], 10) == [(1, 0, 1), (2, 0, 1), (3, 1, 1), (4, 2, 3), (5, 5, 1), (6, 6, 1)]


PLAIN = "the quick river walks under a green stone house while seven people read old letters near warm bread".split()
INSULTS = ["gloomhead", "snarkle", "wretchbag", "dimwort"]


def _hide(word, k):
    return [word, word.upper(), word.replace("e", "3").replace("o", "0"), "-".join(word), " ".join(word), word[0] + word[1] * 4 + word[2:]][k % 6]


def test_toxicity(spark):
    rows, labels = [], []
    for k in range(600):
        words = [RND.choice(PLAIN) + RND.choice(["", ",", "."]) for _ in range(40)]
        toxic = k % 4 == 0
        if toxic:
            for n in range(3):
                words[RND.randrange(40)] = _hide(RND.choice(INSULTS), k // 4 + n)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    d = spark.createDataFrame(rows + [(700, None), (701, ""), (None, "people"), (5, rows[5][1])], "doc_id long, text string").withColumn("toxicity", F.lit(1))
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(d, lab)
    column = toxicity.score_column(d)
    assert column != "toxicity"
    got = toxicity.score(d, model).collect()
    assert len(got) == 604 and all(0 <= r[column].score <= 1 and r[column].predicted == (r[column].score >= 0.5) for r in got)
    held = [(labels[r.doc_id][1], r[column].predicted) for r in got if r.doc_id is not None and r.doc_id < 600 and toxicity._fold(r.doc_id) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) >= 0.95
    restore = toxicity._restorer(model[0])
    assert restore.word("sn4rkl3") == "snarkle" and restore.word("s-n-a-r-k-l-e") == "snarkle" and restore.word("river,") == "river"
    assert toxicity.score(d.limit(0), toxicity.train(d.limit(0), lab)).count() == 0
    assert toxicity.train(d, lab.where("toxic = 0"))[1] == {}


def test_plain_words_between_signs_are_not_looked_up():
    rng = np.random.default_rng(9)
    r = toxicity.Restorer(toxicity.language_model(rng.integers(0, 50, toxicity.CLASSES**3)))
    words = ["people", "aa", "aabb", "letter", "ball", "fußball", "été", "ab"]
    for w in words:
        for written in (w, f"{w},", f'"{w.upper()}."'):
            low = written.lower()
            assert r.word(written) == r._restore(low) == r.lattice(low.strip(toxicity._EDGE)), written
    assert not r.known.young
    for written in ("1d10t", "ab1,", "aaab", "...", "7"):  # these still are
        assert r.word(written) == r._restore(written)
    assert len(r.known.young) == 5
    assert r.readings("People") == "people" and r.readings("a-b").split(" ")[-2:] == ["a", "b"]


def test_heavily_hidden_words_are_restored(spark):
    text = " ".join(f"an idiot and a dumbass met the asshole near a {w} idiot" for w in PLAIN)
    d = spark.createDataFrame([(text,)] * 5, "text string")
    r = toxicity.Restorer(toxicity.language_model(toxicity.trigram_counts(d)))
    for written, word in {"1d10t": "idiot", "!d!0t,": "idiot", "4$$h0l3": "asshole", "dumba$$": "dumbass", "dumba$$!": "dumbass", "idiot!": "idiot", "idiot$$$": "idiot", "i" * 50 + "diot": "idiot", "i" + "-" * 60 + "d1ot": "idiot", "1,000.50": "", "$5": ""}.items():
        assert r.word(written) == word, (written, r.word(written))
    long = "-".join("idiot" * 9)
    assert len(long) > 40 and r.word(long).split(" ") == ["idiot"] * 9
    for written in ("met i d i o t.", "met i  d  i\to t", "met 1 d 1 0 t, and", 'met "i d ! o t"!'):
        assert r.chunks(written)[1] == "idiot", (written, r.chunks(written))
    assert r.chunks("see 1 2 3 4 here") == "see 1 2 3 4 here".split()
    assert "people" in r.readings("people/letters/" * 4 + "bread").split(" ")
    assert toxicity.Scorer(r.model and np.array(r.model).tobytes(), {"idiot": 5.0}).features("seven people met 1d10t here")[0] == 5.0


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, columns, before = docs, docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near-dedup", "secret scan", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = written(stage(spark, rows, sf), "test")
        assert rows.columns == columns
        now = rows.count()
        assert now == before if name == "secret scan" else 0 < now <= before
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows.select("doc_id").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [k for k, t in labels.items() if t == 0]
    assert len([k for k in clean if k in {r.doc_id for r in packed}]) >= 0.6 * len(clean)


def test_pipeline_stages_take_odd_rows(spark):
    """Null and repeated ids, null and empty texts, columns of names that stages use inside, and no rows at all."""
    sf = "/root/testdata/sf0.001"
    names = ("surplus", "kept", "blob", "spans", "verdict", "toxicity", "class", "key", "component", "token")
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(12).collect()]
    rows = [(k, t) for k, t in enumerate([*texts, None, ""])] + [(3, texts[3]), (None, texts[4]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        counts[name] = got.count()
        assert stage(spark, docs.limit(0), sf).count() == 0
        if name != "packing":
            assert got.columns == docs.columns and all(r[n] == n for r in got.collect() for n in names)
    assert counts["secret scan"] == len(rows) and counts["packing"] >= len(rows) and counts["near-dedup"] >= len(texts)


def _restorer(words, times=50):
    from resona.llm import toxicity as tox

    k = [tox._class_of(c) for c in " " + " ".join(words * times) + " "]
    counts = np.bincount([(a * tox.CLASSES + b) * tox.CLASSES + c for a, b, c in zip(k, k[1:], k[2:])], minlength=tox.CLASSES**3)
    return tox.Restorer(tox.language_model(counts))


def _readings(r, written):
    """All readings of what is written, with their costs, one by one."""
    from resona.llm import toxicity as tox

    tail, out = len(written.rstrip(tox._ENDS)), []

    def go(n, a, b, last, cost, text):
        if n == len(written):
            out.append((cost + r.model[a][b][0], text))
            return
        c = written[n]
        letters = [(c, 0.0)] if c.isalpha() else [(x, tox._LOOK) for x in tox.LOOKS.get(c, "")]
        for x, p in letters if c.isalpha() else [*letters, (" ", tox._KEEP)]:
            go(n + 1, b, tox._class_of(x), x, cost + p + r.model[a][b][tox._class_of(x)], text + x)
        if c in tox._SEPARATORS or c in "$!|+(<" or n >= tail:
            go(n + 1, a, b, last, cost + tox._SKIP, text)
        if any(x == last for x, _ in letters):
            long = any(written[k : k + 3] == c * 3 for k in range(max(0, n - 2), n + 1))
            go(n + 1, a, b, last, cost + (tox._REPEAT if long or c != last else r.two[b]), text)

    go(0, 0, 0, "", 0.0, "")
    return out


def test_lattice_equals_all_readings():
    import random

    from resona.llm import toxicity as tox

    r, rnd = _restorer("stone river the idiot silly boot".split()), random.Random(5)
    for _ in range(300):
        written = "".join(rnd.choice("stoneriv" + "10$3!|+-._5") for _ in range(rnd.randrange(1, 8)))
        found = _readings(r, written)
        best = max(cost for cost, _ in found)
        assert r.decode(written) in {" ".join(tox._WORDS.findall(text)) for cost, text in found if cost > best - 1e-9}, written
    for _ in range(500):  # letters alone, as the whole lattice reads them
        written = "".join(rnd.choice("stoneilyé") * rnd.choice((1, 1, 2)) for _ in range(rnd.randrange(1, 9)))
        if tox._THRICE.search(written):
            continue
        best = max(cost for cost, _ in _readings(r, written))
        assert r.decode(written) == r.lattice(written) and r.decode(written) in {text for cost, text in _readings(r, written) if cost > best - 1e-9}, written


def test_plain_words_keep_their_doubled_letters(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = toxicity.Restorer(toxicity.language_model(toxicity.trigram_counts(d)))
    words = [w.lower().strip(toxicity._EDGE) for row in d.limit(300).collect() for w in (row.text or "").split()]
    twice = [w for w in words if toxicity._PLAIN.match(w) and toxicity._TWICE.search(w) and not any(c * 3 in w for c in set(w))]
    assert len(twice) > 1000 and sum(r.word(w) != w for w in twice) < 0.1 * len(twice)
    once = sorted({w for w in words if toxicity._PLAIN.match(w) and not toxicity._TWICE.search(w) and 4 < len(w) < 10})[:500]
    assert sum(r.word(w[0] + w[1] * 3 + w[2:]) == w for w in once) > 0.95 * len(once)  # and repeats are undone
    assert sum(r.word(w[0] + w[1] * 2 + w[2:]) == w for w in once) > 0.7 * len(once)


def test_hidden_words_of_any_kind_are_decoded():
    r = _restorer("stone river the idiot silly".split())
    for written, said in (("5t0n3", "stone"), ("$70n3", "stone"), ("7h3", "the"), ("rriivveerr", "river"), ("1d10t", "idiot"), ("s-t-o-n-e", "stone"), ("sssstttooonnneeee", "stone"), ("r" * 60 + "iver", "river")):
        assert r.word(written) == said, (written, r.word(written))
    assert r.word("70") == ""  # a number
    for text in ("s  t  o  n  e", "a s t o n e.", "5 t 0 n 3!"):
        assert "stone" in " ".join(r.word(c) for c in r.chunks(text)), text
