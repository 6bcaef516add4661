"""Files, extraction, snapshots, streams and the memory that uses them."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from resona.engine import MemoryEngine
from resona.operators import encode
from resona.plans import catalogue
from resona.sources import extract, files, structure
from resona.sources.snapshots import Conflict, Store
from resona.streaming import watch

PY = '''"""Billing rules."""
import os.path
from json import loads

# rounds amounts to cents
def total(x):
    """Adds up."""

class Invoice:
    def pay(self):
        pass

    def _hidden(self):
        pass

    def __init__(self):
        """Starts empty."""
'''


def test_python_units(spark):
    f = spark.createDataFrame([("src/billing.py", PY), ("src/broken.py", "def (:\nan informative line")], "path string, text string")
    got = {r.id: r.content for r in extract.units(f).collect()}
    assert got == {
        "module_billing": "Billing rules.", "billing_total": "Adds up.", "billing_Invoice": "Class 'Invoice' in src/billing.py", "billing_Invoice.pay": "Method 'pay' of 'Invoice'",
        "billing_Invoice.__init__": "Starts empty.", "billing_note_0": "rounds amounts to cents", "file_broken": "an informative line",
    }
    assert {(r.src, r.tgt) for r in extract.relations(f).collect()} == {("billing", "os"), ("billing", "json")}


def test_other_languages(spark):
    rows = {
        "a.ts": "export async function load() {}\nconst go = async (x) => 1\nexport class Box {}\nimport 'lib/my-mod.js'",
        "B.java": "public class B {\n  private static List<String> names(int x) {}\n  public void if (x) {}\n}",
        "c.rs": "pub async fn run() {}\npub struct Café;",
        "d.rb": "class Dog\n  def self.bark?\n  end\nend",
        "e.feature": "Feature: Pay bills\n  Scenario Outline: Pay  twice!\n",
        "f.md": "intro\n# First One\nbody text\n## Second\n",
        "g.c": "int main(int a) {\n}\nif (x) {\n}",
        "h.yaml": "---\nname: something long",
    }
    f = spark.createDataFrame(list(rows.items()), "path string, text string")
    ids = {r.id for r in extract.units(f).collect()}
    assert ids == {
        "module_a", "a_load", "a_go", "a_Box", "module_B", "B_B", "B_names", "module_c", "c_run", "c_Café", "module_d", "d_Dog", "d_bark?", "feature_e", "e_pay__twice_", "doc_f", "f_first_one", "f_second", "module_g", "g_main", "file_h",
    }
    content = {r.id: r.content for r in extract.units(f).collect()}
    assert content["f_first_one"] == "body text" and content["file_h"] == "name: something long" and content["f_second"] == "Section: Second"
    assert [r.tgt for r in extract.relations(f).collect()] == ["my_mod"]


def test_watch_filter(spark):
    paths = [".secret.py", "build/out.js", "logo.svg", "billing/rates.py", "a/.env", "local.env"]
    got = spark.createDataFrame([(p,) for p in paths], "path string").where(files.watched(F.col("path"))).collect()
    assert [r.path for r in got] == ["billing/rates.py"]


def test_distilled(spark):
    replies = [("a", '```json\n{"units":[{"concept":"x","intention":"y","relationships":[{"target":"z","weight":0.5}]}]}\n```'), ("b", 'Sure: {"units":[{"concept":"q"}]} done'), ("c", "nothing")]
    got = files.distilled(spark.createDataFrame(replies, "source string, reply string")).collect()
    assert [(r.source, r.concept) for r in got] == [("a", "x"), ("b", "q")] and got[0].relationships[0].target == "z"


def test_memory(spark, tmp_path):
    root, store = tmp_path / "project", f"file://{tmp_path}/memory"
    os.makedirs(root / "build")
    (root / "billing.py").write_text(PY)
    (root / "notes.md").write_text("# Refunds\nRefunds are paid within a week\n")
    (root / "build" / "x.py").write_text("x = 1")
    m = MemoryEngine(spark, store, dimension=128)
    assert m.stats()["glyphs"] == 0
    assert m.scan(str(root), 1000.0) == {"scanned": 2, "learned": 2, "skipped": 0, "deleted": 0, "errors": 0}
    assert m.scan(str(root), 1001.0)["skipped"] == 2
    assert m.stats()["glyphs"] == 8
    m.learn_offline(["LateFee"], 1002.0, "A fee for late payment", [("LateFee", "Invoice", "raises")])
    q = spark.createDataFrame([("q", "when are refunds paid")], "query_id string, query string")
    found = m.recall(q)
    top = found.orderBy("rank").first()
    assert "efunds" in top.content
    m.commit_activation(found, 2000.0)
    assert m.glyphs().where("activation_count = 1").count() == found.count()
    assert "Resonating patterns" in m.context(m.recall(q)).first().context
    (root / "notes.md").unlink()
    assert {(r.path, r.status) for r in m.changes(str(root)).collect()} == {("notes.md", "deleted")}
    assert m.scan(str(root), 3000.0, prune_missing=True)["deleted"] == 1
    assert m.stats()["glyphs"] == 7
    said = m.forget(1e12)
    assert said["newly_forgotten"] >= 0 and said["before"] == 7
    assert m.unbind_relation("LateFee", "raises").count() >= 0
    nodes, edges, threads = m.graph()
    assert {"module_billing", "billing_total", "billing_invoice", "module_os"} <= {r.id for r in nodes.collect()}
    weight = {(r.src, r.dst): r.weight for r in edges.collect()}
    assert weight["billing_invoice", "module_billing"] == 0.7 and abs(weight["module_billing", "billing_invoice"] - 0.56) < 1e-9
    got = m.graph_recall(spark.createDataFrame([("q", "the invoice"), ("none", "xq")], "query_id string, query string"), 4000.0).collect()
    assert {r.query_id for r in got} == {"q"} and got[0].activation > 0
    assert m.graph()[0].where("id = 'billing_invoice'").first().activation_count == 1
    (root / "billing.py").write_text(PY.replace("Adds up", "Sums up"))
    assert m.learn_file(str(root), "billing.py", 5000.0) and not m.learn_file(str(root), "billing.py", 5001.0)
    assert m.sync(str(root), 6000.0)["skipped"] == 1


def test_scan_paths_and_ignored_files(spark, tmp_path):
    root = tmp_path / "src" / "p {1}+[x]" / "src"
    os.makedirs(root / "src")
    os.makedirs(root / "node_modules")
    for name in ("a.py", "src/b c.md", "node_modules/n.js", "skipped.py", "%20.txt", "no.png"):
        (root / name).write_text("x")
    (root / ".gitignore").write_text("skipped\n# a.py\n")
    found = files.scan(spark, str(root))
    assert sorted(r.path for r in found.collect()) == ["%20.txt", "a.py", "src/b c.md"]
    listed = files.listed(spark, str(root))
    assert {r.path: r.hash for r in files.hashed(listed).collect()} == {r.path: r.hash for r in found.collect()}
    gone = listed.withColumn("uri", F.concat("uri", F.lit("x")))
    assert files.contents(gone).count() == 0 and files.hashed(gone).where("hash is null").count() == 3


def test_of_two_writers_one_is_told(spark, tmp_path):
    rows = lambda k: spark.createDataFrame([(k,)], "k int")
    a, b = Store(spark, f"file://{tmp_path}"), Store(spark, f"file://{tmp_path}")
    assert a.commit(-1, {"t": rows(1)}) == 0
    assert b.read("t", "k int").first().k == 1
    for _ in range(4):  # whichever folder sorts first
        base = a.version()
        assert a.commit(base, {"t": rows(2)}) == base + 1
        with pytest.raises(Conflict):
            b.commit(base, {"t": rows(3)})
    assert [r.k for r in Store(spark, f"file://{tmp_path}").read("t", "k int").orderBy("k").collect()] == [1, 2, 2, 2, 2]


def test_commits_of_several_tables_and_values(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "WHOLE", 3)
    rows = lambda *k: spark.createDataFrame([(x,) for x in k], "k int")
    told = lambda s, t, after=-1: sorted(r.k for r in s.read(t, "k int", after).collect())
    s = Store(spark, str(tmp_path))
    assert s.version() == -1 and told(s, "log") == [] and s.value("n") is None
    for n in range(8):
        s.commit(n - 1, {"log": rows(n)}, {"last": rows(n)}, {"n": n} if n % 2 else None)
        for reader in (s, Store(spark, str(tmp_path))):
            assert reader.version() == n and told(reader, "log") == list(range(n + 1)) and told(reader, "last") == [n]
            assert told(reader, "log", 2) == list(range(3, n + 1)) and reader.value("n") == (n if n % 2 else n - 1 if n else None)


def test_sql_functions(spark):
    from resona import register

    register.register(spark, 8)
    r = spark.sql("SELECT vec_cosine(array(1D, 0D), array(1D, 1D)) c, vec_normalize(array(3D, 4D)) n, vec_involution(array(1D, 2D, 3D)) i, vec_unbind(vec_bind(array(1D, 0D, 0D), array(0.5D, 1D, 2D)), array(1D, 0D, 0D)) u, random_vector(CAST(7 AS DECIMAL(20,0))) v").first()
    assert abs(r.c - 0.5**0.5) < 1e-9 and r.n == [0.6, 0.8] and r.i == [1, 3, 2] and max(abs(x - y) for x, y in zip(r.u, (0.5, 1, 2))) < 1e-9 and len(r.v) == 8
    assert spark.sql("SELECT * FROM python_units('a/m.py', 'def f(): pass')").count() == 2
    rows = [(1, "Parse the cfg of authentication"), (2, "???"), (3, ""), (4, "cfg cfg idx1"), (5, "Élan VITAL deployments")]
    texts = spark.createDataFrame(rows, "k long, t string")
    texts.createOrReplaceTempView("texts")
    want = {r.k: r.vector for r in encode.encode_text(texts, "k", "t", 8).collect()}
    got = {r.k: r.v for r in spark.sql("SELECT k, encode_text(t) v FROM texts").collect()}
    assert got.keys() == want.keys() and all(max(abs(x - y) for x, y in zip(got[k], want[k])) < 1e-9 for k in want)
    summed = {r.g: r.v for r in spark.sql("SELECT k % 2 g, superpose(encode_text(t), CAST(k AS DOUBLE)) v FROM texts GROUP BY k % 2").collect()}
    assert all(max(abs(x - sum(k * want[k][i] for k in want if k % 2 == g)) for i, x in enumerate(v)) < 1e-9 for g, v in summed.items()) and len(summed) == 2


def test_embedder_and_what_it_fails_on(spark):
    import numpy as np

    from resona.operators import encode

    def embedder(texts):
        if any("fail" in t for t in texts):
            raise OSError
        return [[1.0, 0.0] for _ in texts]

    t = spark.createDataFrame([(1, "one"), (2, "fail here")], "k int, t string").repartition(2, "k")
    got = {r.k: np.array(r.vector) for r in encode.embed(t, "k", "t", embedder, 16, 1).collect()}
    own = {r.k: np.array(r.vector) for r in encode.encode_text(t, "k", "t", 16).collect()}
    assert got[1].tolist() == [1.0] + [0.0] * 15 and np.allclose(got[2], own[2])


def test_an_embedder_is_asked_for_a_text_once(spark, tmp_path):
    asked = tmp_path / "asked"

    def embedder(texts):
        with open(asked, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [[float(len(t)), 1.0] for t in texts]

    m = MemoryEngine(spark, f"file://{tmp_path}/m", dimension=8, embedder=embedder)
    for now in (1.0, 2.0):
        m.learn_offline(["SameName", "OtherName", "SameName"], now)
    assert sorted(asked.read_text().split("\n")[:-1]) == ["other name", "same name"]
    assert m.glyphs().where("id = 'SameName'").first().vector[0] > 0.9


def test_graph_from_json(spark, tmp_path):
    from resona.sources import structure

    (tmp_path / "g.json").write_text('{"a": {"created_at": 1.0, "last_activated": 2.0, "activation_count": 3, "edges": {"b": {"weight": 0.5, "created_at": 1.0, "last_activated": 1.0, "activation_count": 0}}}, "b": {"created_at": 1.0, "last_activated": 1.0, "activation_count": 0, "edges": {}}}')
    (tmp_path / "t.json").write_text('{"x": {"content": "hi"}}')
    nodes, edges = structure.graph_json(spark, f"{tmp_path}/g.json")
    assert [(r.id, r.activation_count) for r in nodes.orderBy("seq").collect()] == [("a", 3), ("b", 0)] and edges.first()[:3] == ("a", "b", 0.5)
    assert structure.threads_json(spark, f"{tmp_path}/t.json").first() == ("x", "hi", "", 0.0, 0.0, [], 0)


def test_prompts(spark):
    known = spark.createDataFrame([("b", 1.0, 1), ("a", 2.0, 2), ("gone", 0.0, 3)], "id string, magnitude double, seq int")
    got = files.prompts(spark.createDataFrame([("s", "x" * 9000)], "source string, content string"), known).first().prompt
    assert "Known concepts: b, a." in got and got.endswith("x" * 6000) and "x" * 6001 not in got


def _events(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, 1, at(0)), (2, 1, at(1)), (3, 1, at(2.5)), (4, 2, at(0)), (5, 1, at(3)), (6, 2, at(1.9)), (7, 2, at(2))]
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")


def test_debounce_stream_equals_batch(spark, tmp_path):
    e = _events(spark)
    batch = {r.event_id for r in watch.debounce(e, "user_id").collect()}
    assert batch == {1, 3, 4, 7}
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = watch.debounce_stream(stream, "user_id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch


def test_watch_stream(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.py").write_text("print(1)")
    (root / "b.png").write_text("x")
    seen = []
    q = watch.learn_stream(watch.watch(spark, str(root)), lambda rows: seen.extend(r.path for r in rows.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert seen == ["a.py"]


def test_ground_truth_files_of_three_shapes(spark, tmp_path):
    from resona.operators import evaluate as ev

    for name, text in (
        ("shop", '{"description": "d", "multi_hop_questions": [{"id": "q7", "question": "a?", "hops": 2, "expected_concepts": ["cart"], "answer": "x", "source_files": ["a.py"]}]}'),
        ("ml", '{"multi_hop_questions": [{"question": "b?", "expected_concepts": ["loss", "loss"], "answer": "y"}]}'),
        ("web", '{"project": "Web", "questions": [{"id": 3, "question": "c?", "answer": "z", "hops": 1, "files_needed": ["src/user-card_v2.tsx", "a/user.ts"]}]}'),
    ):
        os.makedirs(tmp_path / name)
        (tmp_path / name / "knowledge.json").write_text(text)
    got = {r.project: r for r in ev.read_ground_truth(spark, [f"{tmp_path}/{n}/knowledge.json" for n in ("shop", "ml", "web")]).collect()}
    assert got["shop"][0] == "q7" and got["shop"].expected == ["cart"] and got["ml"].question_id == "1" and got["Web"].question_id == "3"
    assert sorted(got["Web"].expected) == ["card", "user"] and got["ml"].hops is None


def test_synonyms_from_a_file(spark, tmp_path):
    from resona.functions import synonyms

    (tmp_path / "s.txt").write_text("ship, Boat\n\nship,send\n")
    assert {r.word: r.synonyms for r in synonyms.read(spark, f"{tmp_path}/s.txt").collect()} == {"ship": ["ship", "send"], "boat": ["ship", "boat"], "send": ["ship", "send"]}


def test_facts_and_units_are_made_once_for_each_file(spark):
    files = spark.createDataFrame([("src/a.go", "package a\nfunc f() {}\n"), ("b.py", "def f(): pass\n")], "path string, text string")
    for found in (structure.facts(files), extract.units(files)):
        assert "Filter (size(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_small_tables_that_become_many_files_are_dealt_to_all_tasks(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("code_graph_edges", "code_graph_threads", "extract_code_symbols", "extract_go_symbols", "extract_python_symbols", "import_relations", "random_vectors"):
        assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= parts, name


def test_bigrams_are_counted_where_documents_are_dealt_to(spark):
    plan = catalogue.QUERIES["bigrams"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan  # else a task counts a split, of so many bytes whatever the tasks are
