"""A memory under one folder: learn, scan, recall, forget."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona import schemas
from resona.functions import text as tx, vectors as vx
from resona.operators import encode, graph as gr, plasticity as pl, render, resonate as rs
from resona.operators.lineage import cut
from resona.sources import extract, files, structure
from resona.sources.snapshots import Store

RECALLED, TOGETHER = 0.02, 0.02
#: Commits of region vectors that a recall adds up at most; beyond, their sum is kept.
FOLD = 16


def _taken_back(ledger: DataFrame) -> DataFrame:
    """Rows that undo ledger rows: for each thing bound, the sum of what it gave, negative."""
    kind = F.when(F.col("kind").isin("glyph", "unglyph"), "glyph").otherwise(F.col("kind")).alias("kind")
    rows = ledger.select("region_id", kind, "coeff", "vector", "ref_a", "ref_b", "source", "file")
    by = ["region_id", "kind", "ref_a", "ref_b", "source", "file"]
    return vx.superpose(rows, by, "vector", -F.col("coeff")).select("region_id", "kind", F.lit(1.0).alias("coeff"), "vector", "ref_a", "ref_b", "source", "file")


class MemoryEngine:
    """Everything is derived from what sources gave, in rows that are only added.

    A file that has changed or gone takes back its own share: of its rows those of
    the last commit count, and the regions get what it gave as negative rows. Every
    method that changes state is one commit (``snapshots.Conflict`` if another writer
    was faster) and takes the time, in epoch seconds.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int = encode.DIMENSION, decay_rate: float = 0.01, groups: DataFrame | None = None, embedder: Callable[[list[str]], list | None] | None = None):
        self.spark, self.store, self.dimension, self.decay_rate, self.groups, self.embedder = spark, Store(spark, path), dimension, decay_rate, groups, embedder
        self._told: list[DataFrame] = []  # by the embedder, since the last commit

    # what is there

    def _files(self) -> DataFrame:
        """path, hash, at and batch of the files that the memory holds."""
        last = self.store.read("files", schemas.FILES).groupBy("path").agg(F.max_by(F.struct("hash", "at", "gone", "batch"), "batch").alias("f"))
        return last.where("not f.gone").select("path", "f.hash", "f.at", "f.batch")

    def scan_state(self) -> DataFrame:
        return self._files().select(F.col("path").alias("file_path"), F.col("hash").alias("file_hash"), F.col("at").alias("last_scanned"))

    def _live(self, table: str, schema: str) -> DataFrame:
        """A table's rows without those that files gave which have changed or gone since."""
        rows = self.store.read(table, schema)
        current = self._files().select(F.col("path").alias("source"), "batch", F.lit(True).alias("_current"))
        return rows.join(current, ["source", "batch"], "left").where("not file or _current").select(rows.columns)

    def _births(self, kind: str) -> DataFrame:
        """id, other, created_at, seq and batch of the last time that each came to be."""
        every = self.store.read("births", schemas.BIRTHS).where(F.col("kind") == kind)
        last = every.groupBy("id", "other").agg(F.max_by(F.struct("created_at", "seq", "batch"), "batch").alias("b"))
        return last.select("id", "other", "b.created_at", "b.seq", "b.batch")

    @staticmethod
    def _winners(units: DataFrame) -> DataFrame:
        """One row per id: the last vector, the last content and source that say something, the first region."""
        said = lambda c: F.coalesce(F.max_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("seq"))), F.lit("")).alias(c)
        return units.groupBy("id").agg(F.max_by("vector", "seq").alias("vector"), F.max("at").alias("at"), said("source"), said("content"), F.min_by("region_id", "seq").alias("region_id"))

    def glyphs(self, ids: DataFrame | None = None) -> DataFrame:
        """Units by id, with their strengths as of the last forgetting and the recalls since then; only those of ids, if given."""
        units = self._live("units", schemas.UNITS)
        units = units if ids is None else units.join(ids.select("id"), "id", "left_semi")
        born = self._births("glyph").select("id", "created_at", "seq", "batch")
        kept = self.store.read("strengths", schemas.STRENGTHS).select("id", "magnitude", "last_activated", "activation_count", F.col("batch").alias("_kept"))
        g = self._winners(units).join(born, "id").join(kept, "id", "left")
        mine = F.col("_kept") >= F.col("batch")  # strengths of an earlier glyph of that name don't count
        g = g.select(
            "id", "vector", F.when(mine, F.col("magnitude")).otherwise(1.0).alias("magnitude"), "created_at", F.greatest("at", F.when(mine, F.col("last_activated"))).alias("last_activated"),
            F.when(mine, F.col("activation_count")).otherwise(0).cast("long").alias("activation_count"), "source", "content", "region_id", "seq",
        )
        recalled = self.store.read("activations", schemas.ACTIVATIONS, self.store.value("forgotten", -1))
        recalled = recalled.join(born.select("id", F.col("batch").alias("_born")), "id").where("batch > _born")
        return pl.reinforce(g, recalled)

    def region_vectors(self) -> DataFrame:
        """The kept sums and what was added since then."""
        tail = self.store.read("ledger", schemas.LEDGER, self.store.value("summed", -1)).select("region_id", "coeff", "vector")
        return pl.regions(self.store.read("sums", schemas.SUMS).select("region_id", F.lit(1.0).alias("coeff"), "vector").unionByName(tail))

    def _encoded(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        if self.embedder is None:
            return encode.encode_text(texts, key, text, self.dimension, self.groups)
        told = self.store.read("embedded", schemas.EMBEDDED)
        return encode.embed(texts, key, text, self.embedder, self.dimension, groups=self.groups, known=told, keep=self._told.append)

    def _commit(self, base: int, added: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None, values: dict | None = None) -> int:
        """Stamps rows with the commit, and keeps the sum of the ledger when its tail is long."""
        replaced, values = dict(replaced or {}), dict(values or {})
        stamped = {t: rows.withColumn("batch", F.lit(base + 1).cast("long")) for t, rows in added.items()}
        if self._told:
            stamped["embedded"] = reduce(DataFrame.unionByName, self._told).dropDuplicates(["hash"])
        if "ledger" in added and len(self.store.folders("ledger", self.store.value("summed", -1))) >= FOLD:
            replaced["sums"], values["summed"] = self.region_vectors(), base
        number = self.store.commit(base, stamped, replaced, values, {"units": "region_id"})
        self._told.clear()
        return number

    # learning

    def _store(self, units: DataFrame, now: float, relations: DataFrame | None = None, region: str = "default", facts: DataFrame | None = None, sources: DataFrame | None = None) -> None:
        """One commit of units (id, content, source, encode_input, pos), relations and facts.

        With sources (path, hash, gone) all of it comes from these files, and what they gave before goes.
        """
        base, first, own = self.store.version(), self.store.value("seq", 0), sources is not None
        # numbers rise with the order of the sorted rows, whatever the partitions
        numbered = cut(units.orderBy("source", "pos", "id").withColumn("seq", F.monotonically_increasing_id() + first))
        stamp = {"at": F.lit(now).cast("double"), "file": F.lit(own)}
        new = numbered.join(self._encoded(numbered, "seq", "encode_input"), "seq").select("id", "vector", F.substring("content", 1, 200).alias("content"), "source", F.col("pos").cast("int").alias("pos"), "seq", F.lit(region).alias("region_id"))
        new = cut(new.withColumns(stamp))
        if own:
            sources = cut(sources)
        live = self._live("units", schemas.UNITS).drop("batch")
        files_of = sources.select(F.col("path").alias("source"), F.lit(True).alias("_theirs")) if own else self.spark.createDataFrame([], "source string, _theirs boolean")
        marked = live.join(files_of, "source", "left").withColumn("_goes", F.col("file") & F.col("_theirs").isNotNull()).drop("_theirs")
        touched = cut(new.select("id").unionByName(marked.where("_goes").select("id")).distinct())
        before = cut(self.glyphs(touched).select("id", "vector", "magnitude", "region_id"))
        stays = marked.where("not _goes").drop("_goes").join(touched, "id", "left_semi")
        after = cut(self._winners(stays.unionByName(new)).select("id", F.col("vector").alias("to"), F.col("region_id").alias("region_to")))
        born = after.join(before, "id", "left_anti")
        seq_of = new.groupBy("id").agg(F.min("seq").alias("seq"))
        births = born.join(seq_of, "id").select(F.lit("glyph").alias("kind"), "id", F.lit(None).cast("string").alias("other"), F.lit(now).cast("double").alias("created_at"), "seq")
        ledger = self._moved(before, after).unionByName(self._lost(before.join(after, "id", "left_anti").select("id"), sources))
        if relations is not None:
            ledger = ledger.unionByName(self._bound(relations, region, own))
        added, last = {"units": new, "births": births, "ledger": ledger}, new.agg(F.max("seq")).first()[0]
        if facts is not None:
            drawn = cut(facts.orderBy("source", "pos").withColumn("seq", F.monotonically_increasing_id() + first).withColumns(stamp))
            last = max((x for x in (last, drawn.agg(F.max("seq")).first()[0]) if x is not None), default=None)
            added |= {"facts": drawn, "births": births.unionByName(self._drawn_births(drawn, now))}
        if own:
            added["files"] = sources.select("path", "hash", F.lit(now).cast("double").alias("at"), "gone")
        self._commit(base, added, values={"seq": first if last is None else last + 1})

    def _moved(self, before: DataFrame, after: DataFrame) -> DataFrame:
        """Ledger rows of glyphs that are new, or whose vector is replaced at the magnitude that they have."""
        both = after.join(before, "id", "left").where("vector is null or vector <> to")
        row = lambda kind, coeff, vector: F.struct(F.lit(kind).alias("kind"), coeff.alias("coeff"), vector.alias("vector"))
        rows = F.array_compact(F.array(F.when(F.col("vector").isNotNull(), row("unglyph", -F.col("magnitude"), F.col("vector"))), row("glyph", F.coalesce("magnitude", F.lit(1.0)), F.col("to"))))
        none = F.lit(None).cast("string")
        return both.select(F.coalesce("region_id", "region_to").alias("region_id"), "id", F.explode(rows).alias("e")).select("region_id", "e.kind", "e.coeff", "e.vector", F.col("id").alias("ref_a"), none.alias("ref_b"), none.alias("source"), F.lit(False).alias("file"))

    def _lost(self, ids: DataFrame, sources: DataFrame | None) -> DataFrame:
        """Ledger rows that take back what glyphs (id) that are gone, and the relations of files, gave."""
        ledger = self.store.read("ledger", schemas.LEDGER)
        gone = ids.select(F.col("id").alias("ref_a"))
        own = ledger.where("kind in ('glyph', 'unglyph')").join(gone, "ref_a", "left_semi")
        pairs = ledger.where("kind = 'coact'")
        first, second = pairs.join(gone, "ref_a", "left_semi"), pairs.join(gone, "ref_a", "left_anti").join(gone.withColumnRenamed("ref_a", "ref_b"), "ref_b", "left_semi")
        rows = own.unionByName(first).unionByName(second)
        if sources is not None:
            rows = rows.unionByName(ledger.where("kind = 'relation' and file").join(sources.select(F.col("path").alias("source")), "source", "left_semi"))
        return _taken_back(rows)

    def _bound(self, relations: DataFrame, region: str, own: bool) -> DataFrame:
        bound = encode.encode_relationship(relations, self.dimension)
        return bound.select(F.lit(region).alias("region_id"), F.lit("relation").alias("kind"), F.lit(1.0).alias("coeff"), "vector", F.col("src").alias("ref_a"), F.col("tgt").alias("ref_b"), "source", F.lit(own).alias("file"))

    def _drawn_births(self, facts: DataFrame, now: float) -> DataFrame:
        """Births of the nodes and edges of new facts that are not there yet."""
        keys = lambda f: _nodes_of(f).unionByName(_edges_of(f))
        there = keys(self._live("facts", schemas.FACTS)).select("kind", "id", F.coalesce("other", F.lit("")).alias("_o")).distinct()
        new = keys(facts).groupBy("kind", "id", "other").agg(F.min("seq").alias("seq")).withColumn("_o", F.coalesce("other", F.lit("")))
        return new.join(there, ["kind", "id", "_o"], "left_anti").select("kind", "id", "other", F.lit(now).cast("double").alias("created_at"), "seq")

    def store_units(self, units: DataFrame, now: float, region: str = "default") -> None:
        """Stores units (id, content, source, encode_input, pos) for good."""
        self._store(units, now, region=region)

    def learn(self, content: str | None, now: float, distil: Callable[[DataFrame], DataFrame], source: str = "", path: str | None = None) -> None:
        """distil turns (source, prompt) into (source, reply); the replies' concepts are stored. With a path, its content is learned."""
        told = self.spark.createDataFrame([(source, content)], "source string, content string")
        if path is not None:
            told = self.spark.read.text(path, wholetext=True).select(F.lit(source or path).alias("source"), F.col("value").alias("content"))
        replies = distil(files.prompts(told, self.glyphs()))
        found = files.distilled(replies)
        units = found.select(F.col("concept").alias("id"), F.col("intention").alias("content"), "source", F.concat_ws(" ", "concept", "intention").alias("encode_input"), F.lit(0).alias("pos"))
        self._store(units, now, found.select(F.col("concept").alias("src"), F.explode("relationships").alias("r"), "source").select("src", F.col("r.target").alias("tgt"), F.lit("related").alias("rel_type"), "source"))

    def learn_offline(self, concepts: list[str], now: float, summary: str = "", relationships: list[tuple[str, str, str]] = (), source: str = "") -> None:
        rows = [(c, summary, source, k) for k, c in enumerate(concepts)]
        units = self.spark.createDataFrame(rows, "id string, content string, source string, pos int")
        related = self.spark.createDataFrame([(*r, source) for r in relationships], "src string, tgt string, rel_type string, source string")
        self._store(units.withColumn("encode_input", F.array_join(tx.identifier_words(F.col("id")), " ")), now, related)

    def relate(self, relations: DataFrame, region: str = "default") -> None:
        """Binds relations (src, tgt, rel_type, source) into a region for good."""
        self._commit(self.store.version(), {"ledger": self._bound(relations, region, False)})

    def scan(self, root: str, now: float, force: bool = False, prune_missing: bool = False) -> dict:
        """Learns what has changed under root; how many files were scanned, learned, skipped, deleted, and could not be read.

        Deleted files are counted and stay until prune_missing takes back what they gave. Files are listed once and hashed
        where they are; contents are read again of those that have changed only.
        """
        listed = cut(files.hashed(files.listed(self.spark, root)))
        failed = listed.where("hash is null").select("path")
        status = files.changes(listed.where("hash is not null"), self.scan_state()).join(failed, "path", "left_anti")
        status = cut(status)
        said = files.counters(status, failed).first().asDict()
        wanted = status.where(F.col("status").isin("added", "modified", *(["unchanged"] if force else [])))
        if said["learned"] or force:
            found = files.contents(listed.join(wanted.select("path"), "path", "left_semi"))
        else:
            found = self.spark.createDataFrame([], "path string, content binary, hash string")
        if said["learned"] or force or (prune_missing and said["deleted"]):
            self._take(found, status.where("status = 'deleted'").select("path") if prune_missing else None, now)
        return said

    def learn_files(self, found: DataFrame, now: float) -> int:
        """Learns those of found (path, content, hash), each path once, that have changed; how many."""
        state = self.scan_state().join(found.select(F.col("path").alias("file_path")), "file_path", "left_semi")
        changed = files.changes(found, state).where("status in ('added', 'modified')").select("path")
        new = cut(found.select("path", "content", "hash").join(changed, "path", "left_semi"))
        n = new.count()
        if n:
            self._take(new, None, now)
        return n

    def learn_file(self, root: str, path: str, now: float) -> bool:
        """Learns one file under root if it has changed; whether it had."""
        return self.learn_files(cut(files.single(self.spark, root, path)), now) > 0

    def sync(self, root: str, now: float) -> dict:
        """What a start of a watcher does first: learns what has changed meanwhile, and forgets what is gone."""
        return self.scan(root, now, prune_missing=True)

    def _take(self, found: DataFrame, gone: DataFrame | None, now: float) -> None:
        """One commit of files (path, content, hash) and of those that are gone (path)."""
        texts = cut(found.select("path", extract.normal_text(F.col("content")).alias("text"), "hash"))
        sources = texts.select("path", "hash", F.lit(False).alias("gone"))
        if gone is not None:
            sources = sources.unionByName(gone.select("path", F.lit(None).cast("string").alias("hash"), F.lit(True).alias("gone")))
        texts = texts.select("path", "text")
        self._store(extract.units(texts), now, extract.relations(texts), facts=structure.facts(texts), sources=sources)

    # the graph

    def graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, edges, threads): what was taken over, what facts draw, and how it was used since."""
        facts = self._live("facts", schemas.FACTS)
        given = [self.store.read(f"given_{t}", s) for t, s in (("nodes", schemas.NODES), ("edges", schemas.EDGES), ("threads", schemas.THREADS))]
        uses, none = self.store.read("uses", schemas.USES), F.lit(0).cast("long")
        before = F.lit(self.store.value("given", -1)).cast("long").alias("batch")

        born = self._births("node").join(_nodes_of(facts).select("id").distinct(), "id", "left_semi").join(given[0], "id", "left_anti")
        nodes = born.select("id", "created_at", F.col("created_at").alias("last_activated"), none.alias("activation_count"), "seq", "batch").unionByName(given[0].withColumn("batch", before))
        log = uses.where("other is null").select("ts", "id", F.col("batch").alias("_at")).join(nodes.select("id", "batch"), "id").where("_at > batch")
        nodes = gr.activate(nodes.drop("batch"), log.select("ts", "id"))

        drawn = gr.connect(structure.pairs(facts)).withColumn("n", F.lit(1))  # all draws of an edge are counted
        drawn = drawn.join(self._births("edge").select(F.col("id").alias("src"), F.col("other").alias("dst"), "created_at", "batch"), ["src", "dst"])
        again = self._drawn_again(given[1], facts)
        edges = drawn.join(given[1], ["src", "dst"], "left_anti").select("src", "dst", "weight", "created_at", F.col("created_at").alias("last_activated"), none.alias("activation_count"), "seq", "batch").unionByName(again.withColumn("batch", before))
        log = uses.where("other is not null").select("ts", F.col("id").alias("src"), F.col("other").alias("dst"), F.col("batch").alias("_at")).join(edges.select("src", "dst", "batch"), ["src", "dst"]).where("_at > batch")
        edges = gr.used_edges(edges.drop("batch"), log.select("ts", "src", "dst"))

        threads = gr.upsert_threads(given[2], structure.threads(facts, F.col("at")))
        return nodes, edges, threads

    def _drawn_again(self, given: DataFrame, facts: DataFrame) -> DataFrame:
        """Edges that were taken over, strengthened by each time that facts draw them."""
        both = _edges_of(facts).groupBy(F.col("id").alias("src"), F.col("other").alias("dst")).agg(F.count("*").alias("_n"))
        return given.join(both, ["src", "dst"], "left").withColumn("weight", F.when(F.col("_n").isNull(), F.col("weight")).otherwise(F.least(F.lit(1.0), F.col("weight") + gr.AGAIN * F.col("_n")))).select(given.columns)

    def load_graph(self, graph: str, threads: str | None = None) -> None:
        """Takes over a graph, and threads, that are kept as JSON; they replace what was taken over before."""
        base, (nodes, edges) = self.store.version(), structure.graph_json(self.spark, graph)
        given = {"given_nodes": nodes, "given_edges": edges}
        if threads is not None:
            given["given_threads"] = structure.threads_json(self.spark, threads)
        # what facts draw is counted from here on
        below = lambda rows: rows.withColumn("seq", F.col("seq") - (1 << 62)).select(rows.columns)
        self._commit(base, {}, {t: below(rows) for t, rows in given.items()}, {"given": base + 1})

    def graph_recall(self, queries: DataFrame, now: float, top_k: int = 10) -> DataFrame:
        """query_id, rank, node, activation and content by spreading activation; the edges on the way and the stimuli are strengthened, once a query."""
        base, (nodes, edges, threads) = self.store.version(), self.graph()
        results, used, stimuli = gr.query(queries, cut(nodes), cut(edges), threads, top_k)
        results, at = cut(results), F.lit(now).cast("double").alias("ts")
        log = used.select("query_id", "src", "dst").distinct().select(at, F.col("src").alias("id"), F.col("dst").alias("other"))
        self._commit(base, {"uses": log.unionByName(stimuli.select(at, F.col("node").alias("id"), F.lit(None).cast("string").alias("other")))})
        return results

    def changes(self, root: str) -> DataFrame:
        """path, hash and status of the files that a scan would find changed."""
        listed = files.hashed(files.listed(self.spark, root)).where("hash is not null")
        return files.changes(listed, self.scan_state()).where("status <> 'unchanged'")

    # recalling

    def recall(self, queries: DataFrame, top_k: int = 10, hops: int = 3, region: str = "default") -> DataFrame:
        """query_id, rank, id, score, content, source and activation_count for queries (query_id, query). Changes nothing."""
        g = self.glyphs()
        stimuli = self._encoded(queries, "query_id", "query")
        bound = self.region_vectors().where(F.col("region_id") == region)
        results = rs.multihop(g, stimuli, bound, hops, top_k)
        every = rs.with_fallback(results, g, queries, top_k)
        return every.join(g.select("id", "content", "source", "activation_count"), "id")

    def commit_activation(self, results: DataFrame, now: float) -> None:
        """Strengthens what was recalled, and binds the first three results of each query in pairs."""
        base, results = self.store.version(), cut(results.select("query_id", "rank", "id"))
        log = results.select(F.lit(now).cast("double").alias("ts"), "id", F.lit(RECALLED).alias("amount"))
        g = self.glyphs(results.where("rank <= 3").select("id").distinct())
        vectors = cut(g.select("id", "vector", "region_id", "seq"))
        a = results.where("rank < 3").join(vectors, "id").select("query_id", "rank", F.col("id").alias("ref_a"), F.col("vector").alias("va"), "region_id", "seq")
        b = results.join(vectors, "id").select("query_id", (F.col("rank") - 1).alias("rank"), F.col("id").alias("ref_b"), F.col("vector").alias("vb"))
        bound = pl.co_activate(a.join(b, ["query_id", "rank"]), TOGETHER).select("region_id", "kind", "coeff", "vector", "ref_a", "ref_b", F.lit(None).cast("string").alias("source"), F.lit(False).alias("file"))
        self._commit(base, {"ledger": bound, "activations": log})

    def remember(self, query: str, now: float, top_k: int = 10) -> str:
        """The cognitive map of one question; what was recalled is strengthened."""
        results = cut(self.recall(self.spark.createDataFrame([("q", query)], "query_id string, query string"), top_k))
        told = self.context(results).first()
        self.commit_activation(results, now)
        return render.NOTHING if told is None else told["context"]

    def context(self, results: DataFrame) -> DataFrame:
        return render.cognitive_map(results)

    def forget(self, now: float) -> dict:
        """Lets all glyphs lose strength; before, pruned, after and newly_forgotten."""
        base, before = self.store.version(), cut(self.glyphs())
        after = cut(pl.decay(before, now, self.decay_rate))
        kept = after.select("id", "magnitude", "last_activated", "activation_count", F.lit(base + 1).cast("long").alias("batch"))
        self._commit(base, {}, {"strengths": kept}, {"forgotten": base + 1})
        return pl.forget_summary(before, after).first().asDict()

    def stats(self) -> dict:
        g = self.glyphs()
        return g.agg(F.count("*").alias("glyphs"), F.count(F.when(F.col("magnitude") > 0, 1)).alias("live"), F.countDistinct("region_id").alias("regions"), F.coalesce(F.sum("magnitude"), F.lit(0.0)).alias("magnitude")).first().asDict()

    def unbind_relation(self, source: str, role: str, top_k: int = 5) -> DataFrame:
        """What the region holds as the target of a source and a role."""
        names = self.spark.createDataFrame([("s", source), ("r", role)], "key string, text string")
        known = encode.encode_text(names, "key", "text", self.dimension, self.groups)
        pair = known.groupBy().pivot("key", ["s", "r"]).agg(F.first("vector"))
        region = self.region_vectors().where("region_id = 'default'").select("vector")
        ghost = region.crossJoin(pair).select(F.lit("0").alias("query_id"), vx.unbind_relation(F.col("vector"), F.col("s"), F.col("r")).alias("vector"))  # single rows
        return rs.resonate(self.glyphs(), ghost, top_k)


def _nodes_of(facts: DataFrame) -> DataFrame:
    """kind, id, other (null) and seq of every mention of a node."""
    row = lambda c: facts.where(f"{c} is not null").select(F.lit("node").alias("kind"), F.col(c).alias("id"), F.lit(None).cast("string").alias("other"), "seq")
    return row("id").unionByName(row("other"))


def _edges_of(facts: DataFrame) -> DataFrame:
    """kind, id, other and seq of every draw of an edge, both ways."""
    p = structure.pairs(facts)
    return p.select(F.lit("edge").alias("kind"), F.col("a").alias("id"), F.col("b").alias("other"), "seq").unionByName(p.select(F.lit("edge").alias("kind"), F.col("b").alias("id"), F.col("a").alias("other"), "seq"))
