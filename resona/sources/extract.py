"""Named units out of source code and documents, by Spark's regex functions; Python code by its syntax tree."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from resona.functions import text as tx
from resona.functions.once import once

# Suffixes, what a file is called, and (what, pattern, skipped names) in order of emission.
LANGUAGES: tuple[tuple[tuple[str, ...], str, tuple[tuple[str, str, tuple[str, ...]], ...]], ...] = (
    ((".js", ".ts", ".jsx", ".tsx"), "Module", (
        ("Function", r"(?:export\s+)?(?:async\s+)?function\s+(\w+)", ()),
        ("Function", r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(", ()),
        ("Class", r"(?:export\s+)?class\s+(\w+)", ()),
    )),
    ((".java",), "Java class", (
        ("Class", r"(?:public|private|protected)?\s*(?:class|interface|enum)\s+(\w+)", ()),
        ("Method", r"(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+(\w+)\s*\(", ("if", "for", "while", "switch", "catch")),
    )),
    ((".go",), "Go file", (
        ("Function", r"func\s+(?:\(\w+\s+\*?(\w+)\)\s+)?(\w+)\s*\(", ()),
        ("Type", r"type\s+(\w+)\s+(?:struct|interface)", ()),
    )),
    ((".rs",), "Rust module", (
        ("Function", r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", ()),
        ("Type", r"(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)", ()),
    )),
    ((".cs",), "C# file", (("Class", r"(?:class|interface|record|struct)\s+(\w+)", ()),)),
    ((".c", ".cpp", ".h"), "C/C++ file", (
        ("Function", r"[\w:*&<>]+\s+(\w+)\s*\([^)]*\)\s*(?:const\s*)?\{", ("if", "for", "while", "switch", "return", "sizeof")),
    )),
    ((".rb",), "Ruby file", (("Class", r"(?:class|module)\s+(\w+)", ()), ("Method", r"def\s+(?:self\.)?(\w+[?!]?)", ()))),
    ((".php",), "PHP file", (("Class", r"class\s+(\w+)", ()), ("Function", r"function\s+(\w+)\s*\(", ()))),
    ((".kt",), "Kotlin file", (("Class", r"(?:class|object|interface)\s+(\w+)", ()), ("Function", r"fun\s+(\w+)\s*\(", ()))),
    ((".swift",), "Swift file", (("Type", r"(?:class|struct|protocol|enum|actor)\s+(\w+)", ()), ("Function", r"func\s+(\w+)\s*\(", ()))),
)
# A fixed value.
JS_IMPORT = r"""(?:import|require)\s*\(?["']([^"']+)["']"""

#: The regex flags under which Java's classes are Unicode and only \n ends a line.
_FLAGS = "(?Umd)"
_UNIT = T.StructType([T.StructField(k, T.StringType()) for k in ("id", "name", "content")])


def _unit(context: Column, name: Column, content: Column) -> Column:
    return F.struct(F.concat_ws("_", context, name).alias("id"), name.alias("name"), content.alias("content"))


def matches(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(_FLAGS + pattern), F.lit(group))


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, "^\\s+|\\s+$", "")


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), trimmed)


def code_units(text: Column, path: Column, module: Column, title: str, patterns: tuple) -> Column:
    """The units of a file by its language's patterns."""
    out = [F.array(_unit(F.lit("module"), module, F.concat(F.lit(f"{title} "), path)))]
    for what, pattern, skipped in patterns:
        if pattern.count("(") - pattern.count("(?:") - pattern.count(r"\(") == 2:
            names = F.zip_with(matches(text, pattern, 1), matches(text, pattern, 2), lambda a, b: F.when(a != "", F.concat_ws(".", a, b)).otherwise(b))
        else:
            names = matches(text, pattern, 1)
        if skipped:
            names = F.filter(names, lambda n: ~n.isin(*skipped))
        out.append(F.transform(names, lambda n: _unit(module, n, F.concat(F.lit(f"{what} '"), n, F.lit("' in "), path))))
    return F.concat(*out)


def gherkin_units(text: Column, stem: Column) -> Column:
    # the patterns here and of titles are fixed values
    feature = F.transform(F.slice(matches(text, r"Feature:\s*(.+)$", 1), 1, 1), lambda f: _unit(F.lit("feature"), stem, F.concat(F.lit("Feature: "), trimmed(f))))
    scenarios = matches(text, r"Scenario(?:\s+Outline)?:\s*(.+)$", 1)
    return F.concat(feature, F.transform(scenarios, lambda s: _unit(stem, tx.section_id(s), F.concat(F.lit("Scenario: "), trimmed(s)))))


def section_text(text: Column, title: Column) -> Column:
    """What stands in the 300 characters after a title's first occurrence, without blank lines and titles."""
    at = F.instr(text, title) + F.length(title)
    lines = F.filter(_lines(F.substring(text, at, F.lit(300))), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    return F.when(F.size(lines) > 0, F.substring(F.array_join(lines, " "), 1, 200)).otherwise(F.concat(F.lit("Section: "), trimmed(title)))


def titles(text: Column) -> Column:
    """The first twenty titles of up to three marks."""
    return F.slice(matches(text, r"^#{1,3}\s+(.+)$", 1), 1, 20)


def markdown_units(text: Column, stem: Column) -> Column:
    document = F.array(_unit(F.lit("doc"), stem, F.trim(F.replace(F.substring(text, 1, 500), F.lit("\n"), F.lit(" ")))))
    return F.concat(document, F.transform(titles(text), lambda t: _unit(stem, tx.section_id(t), section_text(text, t))))


def first_informative_line(text: Column) -> Column:
    """Of the first ten lines, the first with more than ten characters and more than marks; null without one."""
    bare = lambda x: F.trim(x, F.lit("#/.*"))
    found = F.filter(F.slice(_lines(text), 1, 10), lambda x: (bare(x) != "") & (F.length(x) > 10))
    return F.substring(bare(F.get(found, F.lit(0))), 1, 150)


def generic_units(text: Column, path: Column, stem: Column) -> Column:
    return F.array(_unit(F.lit("file"), stem, F.coalesce(first_informative_line(text), F.concat(F.lit("File: "), path))))


def _doc(node: ast.AST) -> str:
    first = node.body[0] if node.body else None
    value = first.value if isinstance(first, ast.Expr) else None
    return value.value.strip() if isinstance(value, ast.Constant) and isinstance(value.value, str) else ""


#: The kinds of definitions, by what holds them.
_HELD = {(None, ast.FunctionDef): "Function", (None, ast.AsyncFunctionDef): "Function", (None, ast.ClassDef): "Class", ("Class", ast.FunctionDef): "Method", ("Class", ast.AsyncFunctionDef): "Method"}
_MODULE_DOC, _OTHER_DOC = 500, 300


def definitions(path: str, text: str) -> tuple[ast.Module, list[tuple[str, str | None, str, str, str]]] | None:
    """The syntax tree, and (kind, owner, name, doc, what is said without a doc) of the module and its public definitions; None if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    file = path.rsplit("/", 1)[-1]
    rows = [("Module", None, file.rsplit(".", 1)[0] if "." in file[1:] else file, _doc(tree), f"Module {path}")]
    waiting: list[tuple[str | None, str | None, ast.AST]] = [(None, None, n) for n in reversed(tree.body)]
    while waiting:
        within, owner, node = waiting.pop()
        kind = _HELD.get((within, type(node)))
        if kind is None or kind == "Method" and node.name[0] == "_" and node.name != "__init__":
            continue
        rows.append((kind, owner, node.name, _doc(node), f"Method '{node.name}' of '{owner}'" if owner else f"{kind} '{node.name}' in {path}"))
        if kind == "Class":
            waiting += [(kind, node.name, n) for n in reversed(node.body)]
    return tree, rows


def python_units(path: str, text: str) -> list[tuple[str, str, str]] | None:
    """(id, name, content) of a Python file's module, functions, classes and public methods; None if it does not parse."""
    found = definitions(path, text)
    if found is None:
        return None
    (_, _, module, doc, default), *rest = found[1]
    out = [(f"module_{module}", module, doc[:_MODULE_DOC] or default)]
    for _, owner, name, doc, default in rest:
        full = f"{owner}.{name}" if owner else name
        out.append((f"{module}_{full}", full, doc[:_OTHER_DOC] or default))
    return out


def python_imports(text: str) -> list[str]:
    try:
        nodes = list(ast.walk(ast.parse(text)))
    except (SyntaxError, ValueError, RecursionError):
        return []
    names = [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names] + [n.module for n in nodes if isinstance(n, ast.ImportFrom) and n.module]
    return [n.split(".")[0] for n in names]


@F.pandas_udf(T.ArrayType(_UNIT))
def _python(path: pd.Series, text: pd.Series) -> pd.Series:
    found = (python_units(p, t) for p, t in zip(path, text))
    return pd.Series([None if f is None else [dict(zip(("id", "name", "content"), u)) for u in f] for f in found])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _imports(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in texts:
        yield text.map(python_imports)


def normal_text(content: Column) -> Column:
    """Bytes as text with \\n as the only line end."""
    return F.regexp_replace(content.cast("string"), "\r\n?", "\n")


@once
def _columns() -> tuple[Column, Column]:
    """Units of a file (path, text, and of its path suffix and stem), and of a Python file with what was found in it (found)."""
    path, text, suffix, stem = map(F.col, ("path", "text", "_suffix", "_stem"))
    out = generic_units(text, path, stem)
    for suffixes, title, patterns in LANGUAGES:
        out = F.when(suffix.isin(*suffixes), code_units(text, path, stem, title, patterns)).otherwise(out)
    out = F.when(suffix == ".feature", gherkin_units(text, stem)).when(suffix.isin(".md", ".txt"), markdown_units(text, stem)).otherwise(out)
    notes = F.transform(F.slice(tx.comments(text), 1, 10), lambda c, i: _unit(stem, F.concat(F.lit("note_"), i.cast("string")), c))
    return out, F.when(F.col("found").isNull(), generic_units(text, path, stem)).otherwise(F.concat("found", notes))


def units(files: DataFrame) -> DataFrame:
    """id, content (200 characters at most), source, encode_input, and pos (the order within the file) of files (path, text)."""
    (out, of_python), suffix = _columns(), tx.path_suffix(F.col("path"))
    stem = tx.path_stem(F.col("path")).alias("_stem")
    # Suffix and stem are columns of their own, which the many expressions on them read. Units are exploded where they are
    # made: of a column of them Spark would ask first whether it is empty, and so make them twice and more.
    each = lambda made: ("path", "_stem", F.posexplode(made).alias("pos", "u"))
    python = files.where(suffix == ".py").select("path", "text", stem, _python("path", "text").alias("found")).select(*each(of_python))
    others = files.where(suffix != ".py").select("path", "text", suffix.alias("_suffix"), stem).select(*each(out))
    return others.unionByName(python).select("u.id", F.substring("u.content", 1, 200).alias("content"), F.col("path").alias("source"), F.concat_ws(" ", F.col("u.name"), F.col("u.content"), F.col("_stem")).alias("encode_input"), "pos")


def relations(files: DataFrame) -> DataFrame:
    """src, tgt, rel_type and source of the imports in files (path, text)."""
    suffix, module = tx.path_suffix(F.col("path")), tx.path_stem(F.col("path"))
    script = F.transform(matches(F.col("text"), JS_IMPORT, 1), lambda i: F.replace(tx.path_stem(i), F.lit("-"), F.lit("_")))
    js = files.where(suffix.isin(".js", ".ts", ".jsx", ".tsx")).select(module.alias("src"), F.explode(script).alias("tgt"), "path")
    py = files.where(suffix == ".py").select(module.alias("src"), F.explode(_imports("text")).alias("tgt"), "path")
    return js.unionByName(py).select("src", "tgt", F.lit("imports").alias("rel_type"), F.col("path").alias("source"))
