"""python -m resona.cli FOLDER COMMAND ...: init, scan, sync, watch, recall, context, graph, stats, forget, changes and learn on a memory."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from resona.engine import MemoryEngine
from resona.operators import render
from resona.streaming import watch


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="resona", description=__doc__)
    parser.add_argument("folder")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("init", "scan", "sync", "changes", "watch"):
        commands.add_parser(name).add_argument("root")
    for name in ("recall", "context", "graph"):
        commands.add_parser(name).add_argument("query")
    learn = commands.add_parser("learn")
    learn.add_argument("concepts", nargs="+")
    learn.add_argument("--summary", default="")
    for name in ("stats", "forget"):
        commands.add_parser(name)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("resona").getOrCreate()
    memory = MemoryEngine(spark, a.folder)
    if a.command in ("init", "scan"):
        print(memory.scan(a.root, time.time()))
    elif a.command == "sync":
        print(memory.sync(a.root, time.time()))
    elif a.command == "watch":
        print(memory.sync(a.root, time.time()))
        watch.learn_stream(watch.watch(spark, a.root), lambda rows: memory.learn_files(rows, time.time()), f"{a.folder}/watch", endless=True).awaitTermination()
    elif a.command == "changes":
        memory.changes(a.root).show(20, False)
    elif a.command == "learn":
        memory.learn_offline(a.concepts, time.time(), a.summary)
    elif a.command == "recall":
        print(memory.remember(a.query, time.time()))
    elif a.command == "context":  # the same without strengthening anything
        told = memory.context(memory.recall(spark.createDataFrame([("q", a.query)], "query_id string, query string"))).first()
        print(render.NOTHING if told is None else told["context"])
    elif a.command == "graph":
        memory.graph_recall(spark.createDataFrame([("q", a.query)], "query_id string, query string"), time.time()).orderBy("rank").show(truncate=False)
    elif a.command == "forget":
        print(memory.forget(time.time()))
    else:
        print(memory.stats())


if __name__ == "__main__":
    main()
