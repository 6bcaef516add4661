"""The graph of source files: every part as a small file in each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.sources import structure

from .registry import Family, dealt

family = Family()
QUERIES, SQL = family.queries, family.sql

#: By suffix: the file, its edges, and its threads; ~ is the part's key, M the module's node, F the file's path.
_FILES: dict[str, tuple[str, tuple[tuple[str, str, float], ...], tuple[tuple[str, str], ...]]] = {
    ".ts": (
        "/** Shows. */\nexport function show(a) {}\nexport class Part~ extends Base {}\nimport 'lib/x-y.js'\ninterface Shape {}\n",
        (("p~_show", "M", 0.6), ("p~_part~", "M", 0.7), ("p~_part~", "p~_base", 0.8), ("p~_shape", "M", 0.6), ("M", "module_x_y", 0.5)),
        (("M", "Module F"), ("p~_show", "Shows."), ("p~_part~", "Class 'Part~' in F"), ("p~_shape", "Type/Interface 'Shape' in F")),
    ),
    ".java": (
        "package org.acme;\nimport java.util.List;\n/** A part. */\npublic class Part~ extends Base {\n  public int show(int a) {}\n}\n",
        (("M", "package_org_acme", 0.5), ("M", "module_list", 0.5), ("p~_part~", "M", 0.8), ("p~_part~", "p~_base", 0.8), ("p~_show", "M", 0.7)),
        (("M", "Java class F"), ("p~_part~", "A part."), ("p~_show", "A part.")),
    ),
    ".go": (
        'package shop\nimport "net/http"\n// Shows.\nfunc (p *Part~) Show(a int) {}\ntype Part~ struct {}\n',
        (("p~_part~_show", "M", 0.7), ("p~_part~", "M", 0.7), ("M", "module_http", 0.5)),
        (("M", "Go package 'shop' in F"), ("p~_part~_show", "Shows."), ("p~_part~", "Struct 'Part~' in F")),
    ),
    ".rs": (
        "use std::io::Read;\n/// Shows.\npub fn show(a: i32) {}\npub struct Part~;\n",
        (("p~_show", "M", 0.7), ("p~_part~", "M", 0.7), ("M", "module_read", 0.5)),
        (("M", "Rust module F"), ("p~_show", "Shows."), ("p~_part~", "Type 'Part~' in F")),
    ),
    ".cs": (
        "using System.Text;\nnamespace Acme {\n/// <summary> A part. </summary>\npublic class Part~ {}\n}\n",
        (("p~_part~", "M", 0.8), ("M", "namespace_acme", 0.5), ("M", "module_text", 0.5)),
        (("M", "C# file F"), ("p~_part~", "A part.")),
    ),
    ".hpp": ("#include <my-vec.h>\nstruct Part~ {};\n", (("p~_part~", "M", 0.7), ("M", "module_my_vec", 0.5)), (("M", "C/C++ file F"), ("p~_part~", "Type 'Part~' in F"))),
    ".rb": (
        "require 'set'\nclass Part~\n  def show?\n  end\nend\n",
        (("p~_part~", "M", 0.7), ("p~_show_q", "M", 0.6), ("M", "module_set", 0.5)),
        (("M", "Ruby file F"), ("p~_part~", "Class/Module 'Part~' in F"), ("p~_show_q", "Method 'show?' in F")),
    ),
    ".php": ("use Thing;\nclass Part~ {}\n", (("p~_part~", "M", 0.7), ("M", "module_thing", 0.5)), (("M", "PHP file F"), ("p~_part~", "Class 'Part~' in F"))),
    ".kt": (
        "import a.b.Cee\nobject Part~\nfun show() = 1\n",
        (("p~_part~", "M", 0.7), ("p~_show", "M", 0.6), ("M", "module_cee", 0.5)),
        (("M", "Kotlin file F"), ("p~_part~", "Class 'Part~' in F"), ("p~_show", "Function 'show' in F")),
    ),
    ".swift": (
        "import Core\nstruct Part~ {}\nfunc show() {}\n",
        (("p~_part~", "M", 0.7), ("p~_show", "M", 0.6), ("M", "module_core", 0.5)),
        (("M", "Swift file F"), ("p~_part~", "Type 'Part~' in F"), ("p~_show", "Function 'show' in F")),
    ),
    ".feature": ("Feature: Part ~\n  Scenario: Show it\n", (("p~_show_it", "p~_feature", 0.8),), (("p~_feature", "BDD Feature: Part ~"), ("p~_show_it", "Scenario: Show it"))),
    ".md": ("# One\na line of more text\n## Two\n", (("p~_one", "p~_two", 0.4),), (("p~_one", "a line of more text"), ("p~_two", "Section 'Two' in F"))),
    ".yaml": ("a: 1\n", (), (("config_p~", "Configuration: F"),)),
    ".py": (
        '"""A part."""\nimport os\nclass Part~:\n    def show(self): pass\n',
        (("p~_part~", "M", 0.7), ("p~_part~_show", "p~_part~", 0.85), ("M", "module_os", 0.5)),
        (("M", "A part."), ("p~_part~", "Class 'Part~' in F"), ("p~_part~_show", "Method 'show' of 'Part~'")),
    ),
}


def _sql(x: str, suffix: str) -> str:
    x = f"module_{x[1:] or 'p~'}" if x == "M" else x
    x = x[:-1] + f"src/p~{suffix}" if x.endswith("F") else x
    return "replace('" + x.replace("'", "''") + "', '~', p_partkey::VARCHAR)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    files = F.array(*[F.struct(F.concat(F.lit("src/p"), key, F.lit(s)).alias("path"), F.replace(F.lit(text), F.lit("~"), key).alias("text")) for s, (text, _, _) in _FILES.items()])
    return structure.facts(dealt(spark, sf_dir, "part", "p_partkey").select(F.explode(files).alias("f")).select("f.*")).withColumn("seq", F.col("pos").cast("long"))


@family.query(" UNION ALL ".join(f"SELECT {_sql(a, s)} AS a, {_sql(b, s)} AS b, {w}::DOUBLE AS weight FROM part" for s, (_, edges, _) in _FILES.items() for a, b, w in edges))
def code_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.pairs(_facts(spark, sf_dir)).select("a", "b", "weight")


@family.query(" UNION ALL ".join(f"SELECT {_sql(a, s)} AS id, {_sql(said, s)} AS content FROM part" for s, (_, _, threads) in _FILES.items() for a, said in threads))
def code_graph_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.threads(_facts(spark, sf_dir), 1.0).select("id", "content")
