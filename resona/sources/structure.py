"""Files as a weighted graph: nodes, what is said of them (threads), and edges to what holds or is used by them."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resona.functions import text as tx
from resona.functions.once import once

from .extract import definitions, matches, trimmed

#: How far an edge to what a file uses counts.
USES, INHERITS, FOLLOWS = 0.5, 0.8, 0.4

# Fixed values. By suffixes: what the file is called; (label, pattern, weight, where its comment stands, skipped names,
# whether group 2 is a parent); (pattern, prefix, how the node is named, whether only the first counts).
LANGUAGES = (
    ((".js", ".ts", ".jsx", ".tsx"), "Module", (
        ("Function", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(([^)]*)\)", 0.6, "block", (), False),
        ("Function", r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(([^)]*)\)\s*(?:=>|:)", 0.6, "block", (), False),
        ("Function", r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\w+\s*=>", 0.6, "block", (), False),
        ("Class", r"(?:export\s+)?class\s+(\w+)(?:\s+extends\s+(\w+))?", 0.7, "", (), True),
        ("Type/Interface", r"(?:export\s+)?(?:interface|type)\s+(\w+)", 0.6, "", (), False),
    ), ((r"""(?:import|require)\s*\(?["']([^"']+)["']""", "module_", "stem", False),)),
    ((".java",), "Java class", (
        ("Class", r"(?:public|private|protected)?\s*(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)(?:\s+extends\s+(\w+))?(?:\s+implements\s+([\w,\s]+))?", 0.8, "block", (), True),
        ("Method", r"(?:public|private|protected)\s+(?:static\s+)?(?:[\w<>\[\]]+)\s+(\w+)\s*\(([^)]*)\)", 0.7, "block", ("if", "for", "while", "switch", "catch"), False),
    ), ((r"package\s+([\w.]+);", "package_", "dots", True), (r"import\s+([\w.]+);", "module_", "last . lower", False))),
    ((".rs",), "Rust module", (
        ("Function", r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)", 0.7, "///", (), False),
        ("Type", r"(?:pub\s+)?(?:struct|enum)\s+(\w+)", 0.7, "///", (), False),
        ("Trait", r"(?:pub\s+)?trait\s+(\w+)", 0.7, "", (), False),
    ), ((r"use\s+([\w:]+)", "module_", "last : lower", False),)),
    ((".cs",), "C# file", (
        ("Class", r"(?:public|private|internal|protected)?\s*(?:abstract|static|sealed)?\s*(?:class|interface|record|struct)\s+(\w+)(?:\s*:\s*([\w,\s]+))?", 0.8, "summary", (), False),
        ("Method", r"(?:public|private|protected|internal)\s+(?:static\s+)?(?:async\s+)?(?:[\w<>\[\]?]+)\s+(\w+)\s*\(([^)]*)\)", 0.7, "summary", ("if", "for", "while", "switch", "catch", "class", "new"), False),
    ), ((r"namespace\s+([\w.]+)", "namespace_", "dots lower", True), (r"using\s+([\w.]+);", "module_", "last . lower", False))),
    ((".c", ".cpp", ".h", ".hpp"), "C/C++ file", (
        ("Function", r"(?:[\w:*&<>]+)\s+(\w+)\s*\(([^)]*)\)\s*(?:const\s*)?\{", 0.7, "", ("if", "for", "while", "switch", "return", "sizeof"), False),
        ("Type", r"(?:class|struct)\s+(\w+)", 0.7, "", (), False),
    ), ((r"""#include\s*[<"]([^>"]+)[>"]""", "module_", "stem lower", False),)),
    ((".rb",), "Ruby file", (
        ("Class/Module", r"(?:class|module)\s+(\w+)(?:\s*<\s*(\w+))?", 0.7, "", (), False),
        ("Method", r"def\s+(?:self\.)?(\w+[?!]?)", 0.6, "", (), False),
    ), ((r"""require[_relative]*\s*["']([^"']+)["']""", "module_", "stem", False),)),
    ((".php",), "PHP file", (
        ("Class", r"class\s+(\w+)(?:\s+extends\s+(\w+))?", 0.7, "", (), False),
        ("Function", r"(?:public|private|protected|static)?\s*function\s+(\w+)\s*\(", 0.6, "", (), False),
    ), ((r"""(?:use|require|include)\s+["']?([^"';\s]+)""", "module_", "stem lower", False),)),
    ((".kt",), "Kotlin file", (
        ("Class", r"(?:data\s+|sealed\s+|abstract\s+)?(?:class|object|interface)\s+(\w+)", 0.7, "", (), False),
        ("Function", r"(?:suspend\s+)?fun\s+(?:<[^>]+>\s*)?(\w+)\s*\(", 0.6, "", (), False),
    ), ((r"import\s+([\w.]+)", "module_", "last . lower", False),)),
    ((".swift",), "Swift file", (
        ("Type", r"(?:class|struct|protocol|enum|actor)\s+(\w+)", 0.7, "", (), False),
        ("Function", r"func\s+(\w+)\s*\(", 0.6, "", (), False),
    ), ((r"import\s+(\w+)", "module_", "lower", False),)),
)
GO_FUNCTION = r"func\s+(?:\(\w+\s+\*?(\w+)\)\s+)?(\w+)\s*\(([^)]*)\)"
GO_TYPES = (("Struct", r"type\s+(\w+)\s+struct\s*\{", "//"), ("Interface", r"type\s+(\w+)\s+interface\s*\{", ""))
GO_USES = r'"([\w/.-]+)"'
FEATURE, SCENARIO = r"Feature:\s*(.+)$", r"Scenario(?:\s+Outline)?:\s*(.+)$"
HEADING = r"^(#{1,3}\s+.+)$"
CONFIG = (".json", ".yaml", ".yml", ".toml")
BLOCK, SUMMARY = r"/\*\*\s*\n?\s*\*?\s*(.+?)(?:\n|\*/)", r"<summary>\s*(.+?)\s*</summary>"
PYTHON_WEIGHTS = {"Function": 0.6, "Class": 0.7, "Method": 0.85}


def _fact(id_: Column, content: Column | None = None, other: Column | None = None, weight: float | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(id_.alias("id"), (none if content is None else content).alias("content"), (none if other is None else other).alias("other"), F.lit(weight).cast("double").alias("weight"))


#: Characters before a definition in which its comment is looked for.
ABOVE = 500


def _before(text: Column, pattern: str) -> Column:
    """For each match of the pattern the characters before it, ``ABOVE`` at most, without white space at the end.

    The text is walked once, match by match: what goes along is the end of the
    text so far and the white space after it.
    """
    flagged = "(?Umd)" + pattern
    found, between = F.regexp_extract_all(text, F.lit(flagged), F.lit(0)), F.split(text, flagged, -1)

    def on(s: Column, piece: Column, out: Column) -> Column:
        every = F.concat(s["end"], s["blank"], piece)
        bare = F.rtrim(every, F.lit(" \t\n\x0b\f\r"))
        return F.struct(F.right(bare, F.lit(ABOVE)).alias("end"), F.substring(every, F.length(bare) + 1, F.length(every)).alias("blank"), out.alias("out"))

    def step(s: Column, x: Column) -> Column:
        reached = on(s, x["b"], s["out"])
        return F.element_at(F.transform(F.array(reached), lambda r: on(r, x["m"], F.array_append(r["out"], r["end"]))), 1)  # bound, so that it is not made for each use

    begin = F.struct(F.lit("").alias("end"), F.lit("").alias("blank"), F.array().cast("array<string>").alias("out"))
    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(b.alias("b"), m.alias("m")))
    return F.aggregate(pairs, begin, step, lambda s: s["out"])


def comment_above(before: Column, style: str) -> Column:
    """The first line of the comment that ends the text before a definition, or an empty string."""
    last = trimmed(F.element_at(F.split(before, "\n"), -1))
    line = lambda mark: F.when(F.startswith(last, F.lit(mark)), trimmed(F.regexp_replace(last, "^/+", ""))).otherwise("")
    if style == "block":
        said = trimmed(F.regexp_extract(F.right(before, F.lit(300)), BLOCK, 1))
        said = F.when(said != "", said).otherwise(line("//"))
    elif style == "summary":
        said = trimmed(F.regexp_extract(before, SUMMARY, 1))
    else:
        said = line(style)
    return F.substring(said, 1, 150)


def _used(name: Column, how: str) -> Column:
    if "stem" in how:
        name = F.replace(F.replace(tx.path_stem(name), F.lit("-"), F.lit("_")), F.lit("@"), F.lit(""))
    if "dots" in how:
        name = F.replace(name, F.lit("."), F.lit("_"))
    if "last" in how:
        name = F.element_at(F.split(name, "[" + how.split()[1] + "]"), -1)
    return F.lower(name) if "lower" in how else name


def _code(text: Column, path: Column, module: Column, title: str, kinds: tuple, uses: tuple) -> Column:
    own = F.concat(F.lit("module_"), module)
    out = [F.array(_fact(own, F.concat(F.lit(f"{title} "), path)))]
    for label, pattern, weight, style, skipped, parent in kinds:
        names = matches(text, pattern, 1)
        docs = F.transform(_before(text, pattern), lambda b: comment_above(b, style)) if style else F.transform(names, lambda n: F.lit(""))
        above = matches(text, pattern, 2) if parent else F.transform(names, lambda n: F.lit(""))
        each = F.filter(F.arrays_zip(names.alias("n"), docs.alias("d"), above.alias("p")), lambda x: ~x["n"].isin(*skipped) if skipped else F.lit(True))
        spelled = lambda n: F.regexp_replace(F.regexp_replace(n, "[?]", "_q"), "!", "_bang")
        said = lambda x: F.when(x["d"] != "", x["d"]).otherwise(F.concat(F.lit(f"{label} '"), x["n"], F.lit("' in "), path))
        out.append(F.transform(each, lambda x: _fact(tx.make_id(spelled(x["n"]), module), said(x), own, weight)))
        if parent:
            out.append(F.transform(F.filter(each, lambda x: x["p"] != ""), lambda x: _fact(tx.make_id(x["n"], module), None, tx.make_id(x["p"], module), INHERITS)))
    for pattern, prefix, how, once in uses:
        found = matches(text, pattern, 1)
        out.append(F.transform(F.slice(found, 1, 1) if once else found, lambda n: _fact(own, None, F.concat(F.lit(prefix), _used(n, how)), USES)))
    return F.concat(*out)


def _go(text: Column, path: Column, module: Column) -> Column:
    own = F.concat(F.lit("module_"), module)
    package = F.regexp_extract(text, r"package\s+(\w+)", 1)
    said = F.concat(F.lit("Go package '"), F.when(package != "", package).otherwise(module), F.lit("' in "), path)
    docs = F.transform(_before(text, GO_FUNCTION), lambda b: comment_above(b, "//"))
    each = F.arrays_zip(matches(text, GO_FUNCTION, 1).alias("r"), matches(text, GO_FUNCTION, 2).alias("n"), docs.alias("d"))
    method = lambda x: F.concat(F.lit("Method '"), x["n"], F.lit("' on '"), x["r"], F.lit("' in "), path)
    plain = lambda x: F.concat(F.lit("Function '"), x["n"], F.lit("' in "), path)
    name = lambda x: F.when(x["r"] != "", F.concat_ws("_", x["r"], x["n"])).otherwise(x["n"])
    out = [F.array(_fact(own, said)), F.transform(each, lambda x: _fact(tx.make_id(name(x), module), F.when(x["d"] != "", x["d"]).when(x["r"] != "", method(x)).otherwise(plain(x)), own, 0.7))]
    for label, pattern, style in GO_TYPES:
        names = matches(text, pattern, 1)
        docs = F.transform(_before(text, pattern), lambda b: comment_above(b, style)) if style else F.transform(names, lambda n: F.lit(""))
        typed = F.arrays_zip(names.alias("n"), docs.alias("d"))
        out.append(F.transform(typed, lambda x: _fact(tx.make_id(x["n"], module), F.when(x["d"] != "", x["d"]).otherwise(F.concat(F.lit(f"{label} '"), x["n"], F.lit("' in "), path)), own, 0.7)))
    head = F.when(F.contains(text, F.lit("func ")), F.substring_index(text, "func ", 1)).otherwise(F.substring(text, 1, 500))
    used = lambda n: F.replace(F.element_at(F.split(n, "/"), -1), F.lit("-"), F.lit("_"))
    return F.concat(*out, F.transform(matches(head, GO_USES, 1), lambda n: _fact(own, None, F.concat(F.lit("module_"), used(n)), USES)))


def _document(stem: Column) -> Column:
    return F.replace(F.lower(stem), F.lit(" "), F.lit("_"))


def _gherkin(text: Column, stem: Column) -> Column:
    name = _document(stem)
    feature = F.slice(matches(text, FEATURE, 1), 1, 1)
    id_ = tx.make_id(F.lit("feature"), name)
    scenarios = F.transform(matches(text, SCENARIO, 1), lambda s: trimmed(s))
    other = F.when(F.size(feature) > 0, id_)
    said = F.transform(scenarios, lambda s: F.struct(tx.make_id(F.substring(s, 1, 40), name).alias("id"), F.concat(F.lit("Scenario: "), s).alias("content"), other.alias("other"), F.when(other.isNotNull(), F.lit(INHERITS)).alias("weight")))
    return F.concat(F.transform(feature, lambda f: _fact(id_, F.concat(F.lit("BDD Feature: "), trimmed(f)))), said)


def _markdown(text: Column, path: Column, stem: Column) -> Column:
    """The first twenty sections; each but the first is what follows the one before."""
    name = _document(stem)
    title = lambda h: F.regexp_extract(h, r"^#{1,3}\s+(.+)$", 1)
    headings = F.slice(matches(text, HEADING, 1), 1, 20)
    ids = F.transform(headings, lambda h: tx.make_id(F.substring(trimmed(title(h)), 1, 40), name))

    def said(h: Column) -> Column:
        after = F.substring(text, F.instr(text, h), F.length(text))
        lines = F.transform(F.slice(F.split(after, "\n"), 2, 4), trimmed)
        first = F.get(F.filter(lines, lambda x: ~F.startswith(x, F.lit("#")) & (F.length(x) > 10)), F.lit(0))
        return F.coalesce(F.substring(first, 1, 150), F.concat(F.lit("Section '"), trimmed(title(h)), F.lit("' in "), path))

    threads = F.transform(headings, lambda h, k: _fact(F.get(ids, k), said(h)))
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.concat(threads, F.zip_with(F.slice(ids, F.lit(1), n), F.slice(ids, F.lit(2), n), lambda a, b: _fact(a, None, b, FOLLOWS)))


def _whole(text: Column, path: Column, stem: Column) -> Column:
    """A file as one node: its first line of more than ten characters without marks, of the first ten lines."""
    stem = F.regexp_replace(F.lower(stem), "[-.]", "_")
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 10), lambda x: trimmed(F.trim(F.trim(F.trim(trimmed(x), F.lit("#")), F.lit("/")), F.lit("*"))))
    first = F.get(F.filter(lines, lambda x: F.length(x) > 10), F.lit(0))
    return F.array(_fact(F.concat(F.lit("file_"), stem), F.coalesce(F.substring(first, 1, 150), F.concat(F.lit("File: "), path))))


def _config(path: Column, stem: Column) -> Column:
    return F.array(_fact(F.concat(F.lit("config_"), F.replace(F.lower(stem), F.lit("."), F.lit("_"))), F.concat(F.lit("Configuration: "), path)))


def python_facts(path: str, text: str) -> list[tuple[str, str, str | None, float | None]] | None:
    """(kind, name, content, owner) of a Python file by its definitions, and ("use", module, None, None) of its imports; None if it does not parse."""
    found = definitions(path, text)
    if found is None:
        return None
    tree, rows = found
    line = lambda doc: doc.split("\n")[0][:150]
    names = [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names] + [n.module for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module]
    own = [(kind, name, line(doc) or default, owner) for kind, owner, name, doc, default in rows]
    return own + [("use", n.split(".")[0], None, None) for n in names]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(k, T.StringType()) for k in ("kind", "name", "content", "owner")])))
def _python(path: pd.Series, text: pd.Series) -> pd.Series:
    found = (python_facts(p, t) for p, t in zip(path, text))
    return pd.Series([None if f is None else [dict(zip(("kind", "name", "content", "owner"), x)) for x in f] for f in found])


def _python_structure(found: Column, module: Column) -> Column:
    own = F.concat(F.lit("module_"), module)
    weight = F.create_map(*[x for k, w in PYTHON_WEIGHTS.items() for x in (F.lit(k), F.lit(w))])
    named = lambda x: tx.make_id(F.when(x["owner"].isNull(), x["name"]).otherwise(F.concat_ws("_", x["owner"], x["name"])), module)
    held = lambda x: F.when(x["owner"].isNull(), own).otherwise(tx.make_id(x["owner"], module))

    def one(x: Column) -> Column:
        id_ = F.when(x["kind"].isin("Module", "use"), own).otherwise(named(x))
        other = F.when(x["kind"] == "use", F.concat(F.lit("module_"), x["name"])).when(x["kind"] != "Module", held(x))
        return F.struct(id_.alias("id"), x["content"].alias("content"), other.alias("other"), F.when(x["kind"] == "use", F.lit(USES)).otherwise(F.element_at(weight, x["kind"])).alias("weight"))

    return F.transform(found, one)


@once
def _columns() -> tuple[Column, Column]:
    """Facts of a file (path, text, and of its path suffix and stem), and of a Python file with what was found in it (found)."""
    path, text, suffix, stem = map(F.col, ("path", "text", "_suffix", "_stem"))
    out = F.when(suffix.isin(*CONFIG), _config(path, stem)).otherwise(_whole(text, path, stem))
    for suffixes, title, kinds, uses in LANGUAGES:
        out = F.when(suffix.isin(*suffixes), _code(text, path, stem, title, kinds, uses)).otherwise(out)
    out = F.when(suffix == ".go", _go(text, path, stem)).when(suffix == ".feature", _gherkin(text, stem)).when(suffix.isin(".md", ".txt", ".rst"), _markdown(text, path, stem)).otherwise(out)
    return out, F.when(F.col("found").isNull(), _whole(text, path, stem)).otherwise(_python_structure(F.col("found"), stem))


def facts(files: DataFrame) -> DataFrame:
    """source, pos, id, content, other and weight of files (path, text): a content makes a thread, another node an edge."""
    (out, of_python), suffix = _columns(), tx.path_suffix(F.col("path"))
    stem = tx.path_stem(F.col("path")).alias("_stem")
    # Suffix and stem are columns of their own, which the many expressions on them read. Facts are exploded where they are
    # made: of a column of them Spark would ask first whether it is empty, and so make them twice and more.
    each = lambda made: (F.col("path").alias("source"), F.posexplode(made).alias("pos", "f"))
    python = files.where(suffix == ".py").select("path", "text", stem, _python("path", "text").alias("found")).select(*each(of_python))
    others = files.where(suffix != ".py").select("path", "text", suffix.alias("_suffix"), stem).select(*each(out))
    return others.unionByName(python).select("source", "pos", "f.*")


def threads(found: DataFrame, now: float | Column) -> DataFrame:
    """One row per thread that facts (with seq) make: id, content, source, created_at, updated_at, node_refs, seq."""
    said = found.where("content is not null")
    return said.select("id", "content", "source", F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.array("id").alias("node_refs"), "seq")


def pairs(found: DataFrame) -> DataFrame:
    """seq, a, b and weight of the edges that facts (with seq) make."""
    return found.where("other is not null").select("seq", F.col("id").alias("a"), F.col("other").alias("b"), "weight")


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph kept as JSON: a map of nodes, each with its edges."""
    edge = "struct<weight:double,created_at:double,last_activated:double,activation_count:long>"
    schema = f"map<string,struct<created_at:double,last_activated:double,activation_count:long,edges:map<string,{edge}>>>"
    each = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(F.from_json("value", schema))).alias("seq", "e")).select(F.col("seq").cast("long").alias("seq"), F.col("e.key").alias("id"), "e.value.*")
    nodes = each.select("id", "created_at", "last_activated", "activation_count", "seq")
    edges = each.select(F.col("seq").alias("n"), F.col("id").alias("src"), F.posexplode(F.map_entries("edges")).alias("k", "e"))
    return nodes, edges.select("src", F.col("e.key").alias("dst"), "e.value.*", (F.shiftleft("n", 32) + F.col("k")).alias("seq"))


def threads_json(spark: SparkSession, path: str) -> DataFrame:
    """Threads kept as JSON: a map of threads; what a thread lacks is empty, or 0 for times."""
    schema = "map<string,struct<content:string,source:string,created_at:double,updated_at:double,node_refs:array<string>>>"
    each = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(F.from_json("value", schema))).alias("seq", "e")).select(F.col("seq").cast("long").alias("seq"), F.col("e.key").alias("id"), "e.value.*")
    filled = {"content": F.lit(""), "source": F.lit(""), "created_at": F.lit(0.0), "updated_at": F.lit(0.0), "node_refs": F.array().cast("array<string>")}
    return each.select("id", *[F.coalesce(c, d).alias(c) for c, d in filled.items()], "seq")
