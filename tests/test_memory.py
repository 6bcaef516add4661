"""A memory over its life: what files gave and took back, use, forgetting, commits."""

import os

import numpy as np
import pytest

from resona import engine
from resona.engine import MemoryEngine
from resona.operators import plasticity as pl
from resona.sources import extract, files
from resona.sources.snapshots import Conflict

A = '"""Billing."""\nimport os\n\ndef total(x):\n    """Adds up."""\n\nclass Invoice:\n    def pay(self): pass\n'
B = "# Refunds\nRefunds are paid within a week\n## Late refunds\nThey cost a fee\n"
C = "import 'lib/cart.js'\nexport function show(a) {}\nexport class Cart extends Base {}\n"


@pytest.fixture
def root(tmp_path):
    root = tmp_path / "project"
    os.makedirs(root)
    for name, text in (("a.py", A), ("b.md", B), ("c.ts", C)):
        (root / name).write_text(text)
    return root


def _memory(spark, folder):
    return MemoryEngine(spark, f"file://{folder}", dimension=64)


def _state(m):
    """All that a memory holds, without times and places in order."""
    nodes, edges, threads = m.graph()
    return (
        {r.id: (r.content, r.source, r.region_id, r.magnitude, np.round(r.vector, 9).tolist()) for r in m.glyphs().collect()},
        {r.id for r in nodes.collect()},
        {(r.src, r.dst): round(r.weight, 9) for r in edges.collect()},
        {r.id: (r.content, r.source, r.node_refs) for r in threads.collect()},
        {r.file_path: r.file_hash for r in m.scan_state().collect()},
    )


def _regions(m):
    return {r.region_id: np.array(r.vector) for r in m.region_vectors().collect()}


def test_change_delete_sync_equals_a_fresh_scan(spark, root, tmp_path):
    m = _memory(spark, tmp_path / "m")
    assert m.scan(str(root), 1.0) == {"scanned": 3, "learned": 3, "skipped": 0, "deleted": 0, "errors": 0}
    (root / "a.py").write_text(A.replace("total", "tally").replace("pay", "refund"))
    (root / "c.ts").unlink()
    (root / "d.md").write_text("# Stock\nParts lie on shelves\n")
    # a plain scan learns and counts; what is deleted stays and is found again later
    assert m.scan(str(root), 2.0) == {"scanned": 3, "learned": 2, "skipped": 1, "deleted": 1, "errors": 0}
    assert m.glyphs().where("id = 'c_Cart'").count() == 1
    assert m.sync(str(root), 3.0)["deleted"] == 1 and m.sync(str(root), 4.0)["deleted"] == 0
    fresh = _memory(spark, tmp_path / "fresh")
    fresh.scan(str(root), 1.0)
    got, want = _state(m), _state(fresh)
    assert got == want and "c_Cart" not in got[0] and ("c_show", "module_c") not in got[2]
    there, anew = _regions(m), _regions(fresh)
    assert there.keys() == anew.keys() and all(np.allclose(there[k], anew[k], atol=1e-9) for k in there)
    # what was not changed is as old as it was
    born = {r.id: r.created_at for r in m.glyphs().collect()}
    assert born["b_refunds"] == 1.0 and born["a_Invoice"] == 1.0 and born["a_tally"] == 2.0


def test_a_glyph_of_two_files_outlives_one(spark, tmp_path):
    m = _memory(spark, tmp_path / "m")
    found = lambda *rows: files.F and spark.createDataFrame(rows, "path string, content binary, hash string")
    m.learn_files(found(("x/a.md", b"# Same\nfrom the first file\n", "1"), ("y/a.md", b"# Same\nfrom the second file\n", "2")), 1.0)
    assert m.glyphs().where("id = 'a_same'").first().content == "from the second file"
    gone = spark.createDataFrame([("y/a.md",)], "path string")
    m._take(found(), gone, 2.0)
    assert m.glyphs().where("id = 'a_same'").first().content == "from the first file"
    alone = _memory(spark, tmp_path / "alone")
    alone.learn_files(found(("x/a.md", b"# Same\nfrom the first file\n", "1")), 1.0)
    assert np.allclose(_regions(m)["default"], _regions(alone)["default"], atol=1e-9)


def test_recalls_bind_and_go_with_their_glyphs(spark, root, tmp_path):
    m = _memory(spark, tmp_path / "m")
    m.scan(str(root), 1.0)
    q = spark.createDataFrame([("q", "show the cart")], "query_id string, query string")
    found = m.recall(q)
    m.commit_activation(found, 2.0)
    recalled = {r.id for r in found.collect()}
    assert {r.id for r in m.glyphs().where("activation_count = 1 and last_activated = 2.0").collect()} == recalled
    said = m.forget(3.0)
    kept = {r.id: (r.magnitude, r.activation_count) for r in m.glyphs().collect()}
    assert said["after"] == len(kept) and all(kept[i] == (kept[i][0], 1) and kept[i][0] > 1 for i in recalled)
    for name in ("a.py", "b.md", "c.ts"):
        (root / name).unlink()
    assert m.sync(str(root), 4.0)["deleted"] == 3 and m.stats()["glyphs"] == 0
    assert all(np.allclose(v, 0, atol=1e-9) for v in _regions(m).values())
    (root / "c.ts").write_text(C)  # of the same names, but new
    m.sync(str(root), 5.0)
    assert {(r.magnitude, r.activation_count, r.created_at) for r in m.glyphs().collect()} == {(1.0, 0, 5.0)}


def test_edges_remember_their_use(spark, tmp_path):
    m = _memory(spark, tmp_path / "m")
    text = "".join(f"## Pay {w}\nsome text about it\n" for w in ("one", "two", "three", "four", "five", "six", "seven", "eight"))
    m.learn_files(spark.createDataFrame([("p.md", text.encode(), "1")], "path string, content binary, hash string"), 1.0)
    before = {(r.src, r.dst): r for r in m.graph()[1].collect()}
    q = spark.createDataFrame([("q", "pay"), ("r", "pay")], "query_id string, query string")
    assert m.graph_recall(q, 9.0).count() > 5
    nodes, edges, _ = m.graph()
    # the first five named nodes are stimuli, of two queries each
    assert {r.id: r.activation_count for r in nodes.where("activation_count > 0").collect()} == {f"pay_{w}": 2 for w in ("one", "two", "three", "four", "five")}
    used = edges.where("activation_count > 0").collect()
    assert used and all(r.last_activated == 9.0 and r.activation_count == 2 and abs(r.weight - min(1, before[r.src, r.dst].weight + 0.04)) < 1e-9 for r in used)
    assert all(r.last_activated == 1.0 for r in edges.where("activation_count = 0").collect())


def test_an_edge_is_strengthened_by_each_draw(spark, tmp_path):
    m = _memory(spark, tmp_path / "m")
    found = lambda n: spark.createDataFrame([("m.js", b"import 'x'\n" * n, str(n))], "path string, content binary, hash string")
    weight = lambda: m.graph()[1].where("src = 'module_m' and dst = 'module_x'").first().weight
    m.learn_files(found(1), 1.0)
    assert weight() == 0.5
    m.learn_files(found(4), 2.0)
    assert abs(weight() - 0.8) < 1e-9


def test_graph_that_was_taken_over(spark, tmp_path):
    m = _memory(spark, tmp_path / "m")
    (tmp_path / "g.json").write_text('{"module_m": {"created_at": 1.0, "last_activated": 2.0, "activation_count": 3, "edges": {"module_x": {"weight": 0.3, "created_at": 1.0, "last_activated": 1.0, "activation_count": 0}}}, "module_x": {"created_at": 1.0, "last_activated": 1.0, "activation_count": 0, "edges": {}}}')
    (tmp_path / "t.json").write_text('{"module_m": {"content": "old", "source": "s", "node_refs": ["module_m"]}}')
    m.load_graph(f"{tmp_path}/g.json", f"{tmp_path}/t.json")
    m.learn_files(spark.createDataFrame([("m.js", b"import 'x'\n", "1")], "path string, content binary, hash string"), 5.0)
    nodes, edges, threads = m.graph()
    assert nodes.where("id = 'module_m'").first()[1:4] == (1.0, 2.0, 3)
    assert {(r.src, r.dst): round(r.weight, 9) for r in edges.collect()} == {("module_m", "module_x"): 0.4, ("module_x", "module_m"): 0.4}
    assert (threads.first().content, threads.first().source) == ("Module m.js", "s")


def test_sums_of_regions_are_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engine, "FOLD", 2)
    m = _memory(spark, tmp_path / "m")
    for k in range(5):
        m.learn_offline([f"Concept{k % 3}", f"Other{k}"], float(k), f"text {k}", [(f"Other{k}", "Concept0", "uses")])
    m.store_units(spark.createDataFrame([("x", "y", "s", "words", 0)], "id string, content string, source string, encode_input string, pos int"), 9.0, region="second")
    kept, whole = _regions(m), {r.region_id: np.array(r.vector) for r in pl.regions(m.store.read("ledger", engine.schemas.LEDGER)).collect()}
    assert kept.keys() == whole.keys() == {"default", "second"} and all(np.allclose(kept[k], whole[k]) for k in kept)
    assert m.store.value("summed") >= 3 and len(m.store.folders("ledger", m.store.value("summed"))) <= 3
    assert m.store.read("units", engine.schemas.UNITS).where("region_id = 'second'").count() == 1
    assert "region_id=second" in " ".join(os.listdir(m.store.folders("units")[-1].removeprefix("file://")))


def test_writers_that_meet_are_told(spark, tmp_path):
    a, b = _memory(spark, tmp_path / "m"), _memory(spark, tmp_path / "m")
    a.learn_offline(["One"], 1.0)
    seen = b.store.version()
    a.learn_offline(["Two"], 2.0)
    b.store.version = lambda: seen
    with pytest.raises(Conflict):
        b.learn_offline(["Three"], 3.0)
    assert {r.id for r in a.glyphs().collect()} == {"One", "Two"}


def _jobs(spark, name, do):
    spark.sparkContext.setJobGroup(name, name)
    do()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def _written(m):
    """Bytes of the last commit's rows."""
    n, root = m.store.version(), m.store.path.removeprefix("file://")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f"commit=v{n}-" in d and f.endswith(".parquet"))


def test_a_batch_costs_as_many_jobs_as_a_file(spark, tmp_path):
    m = _memory(spark, tmp_path / "m")
    found = lambda lo, hi: spark.createDataFrame([(f"n{k}.md", f"# Note {k}\nabout {k}\n".encode(), str(k)) for k in range(lo, hi)], "path string, content binary, hash string")
    m.learn_files(found(0, 1), 1.0)
    one = _jobs(spark, "one", lambda: m.learn_files(found(1, 2), 2.0))
    first = _written(m)
    many = _jobs(spark, "many", lambda: m.learn_files(found(2, 202), 3.0))
    assert many <= one + 2 and m.learn_files(found(0, 202), 4.0) == 0
    m.learn_files(found(300, 301), 5.0)  # a file costs no more in a memory of two hundred
    assert _written(m) < 1.2 * first + 2000


def test_an_unchanged_scan_commits_nothing(spark, root, tmp_path):
    m = _memory(spark, tmp_path / "m")
    m.scan(str(root), 1.0)
    at = m.store.version()
    assert m.scan(str(root), 2.0)["skipped"] == 3 and m.sync(str(root), 2.0)["learned"] == 0 and m.store.version() == at
    (root / "big.md").write_text("# Big\n" + "x" * files.LARGEST)  # beyond the size that is read
    assert m.scan(str(root), 3.0)["scanned"] == 3
    assert extract.units(spark.createDataFrame([], "path string, text string")).count() == 0
