"""Text functions and extraction over documents, parts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.functions import synonyms, text as tx
from resona.operators import encode
from resona.sources import extract, files

from .registry import Family, dealt, table

family = Family()
QUERIES, SQL = family.queries, family.sql

_TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 2)"
_T = f"t AS (SELECT doc_id, {_TOKENS} AS w FROM documents)"
_STEM = "CASE WHEN length(w) <= 4 THEN w " + " ".join(f"WHEN ends_with(w, '{s}') AND length(w) - {len(s)} >= 3 THEN substr(w, 1, length(w) - {len(s)})" for s in tx.SUFFIXES) + " ELSE w END"
_GROUPS = "syn AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', [{', '.join(repr(x) for x in g)}])" for w, g in sorted({w: g for g in synonyms.GROUPS for w in g}.items())) + ") AS s(word, synonyms))"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("w"))


@family.query(f"WITH {_T} SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, md5(array_to_string(w, ' ')) AS tokens_md5 FROM t")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


@family.query(r"SELECT p_partkey, array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(name, '[-_]', ' ', 'g'), '([A-Z])', ' \1', 'g'), '\s+'), lambda x: length(x) >= 2), lambda x: lower(x)), ' ') AS words FROM (SELECT p_partkey, replace(p_name, ' ', '_') || '-' || replace(p_type, ' ', 'Of') AS name FROM part)")
def split_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), F.replace("p_type", F.lit(" "), F.lit("Of"))).alias("name"))
    return p.select("p_partkey", F.array_join(tx.identifier_words(F.col("name")), " ").alias("words"))


@family.query(f"WITH {_T}, d AS (SELECT DISTINCT unnest(w) AS w FROM t) SELECT w AS word, {_STEM} AS stem FROM d")
def stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select(F.explode("w").alias("word")).distinct().select("word", tx.stem(F.col("word")).alias("stem"))


@family.query(f"WITH {_T}, {_GROUPS}, d AS (SELECT DISTINCT doc_id, unnest(w) AS w FROM t), x AS (SELECT doc_id, unnest(list_distinct(list_concat([w], coalesce(synonyms, [])))) AS expanded FROM d LEFT JOIN syn ON d.w = syn.word) SELECT expanded, count(*) AS n FROM x GROUP BY expanded")
def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _tokens(spark, sf_dir).select("doc_id", F.explode(F.array_distinct("w")).alias("w"))
    return synonyms.expand(d, "w", synonyms.table(spark)).groupBy("expanded").agg(F.count("*").alias("n"))


@family.query(f"WITH {_T}, p AS (SELECT unnest(list_zip(w[:-2], w[2:])) AS p FROM t) SELECT p[1] || '_' || p[2] AS bigram, count(*) AS n FROM p GROUP BY ALL")
def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are dealt to all tasks, so that what one task counts is bounded by their number, not by a split's bytes."""
    w = dealt(spark, sf_dir, "documents", "doc_id").select(tx.tokens(F.col("text")).alias("w"))
    return w.select(F.explode(tx.bigrams(F.col("w"))).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


@family.query(f"WITH {_T}, j AS (SELECT array_to_string(w, '') AS s FROM t), i AS (SELECT s, unnest(range(1, length(s) - 1)) AS k FROM j) SELECT substr(s, k, 3) AS trigram, count(*) AS n FROM i WHERE regexp_full_match(substr(s, k, 3), '[a-z]{{3}}') GROUP BY ALL")
def trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).select(F.explode(tx.trigrams(F.col("w"))).alias("trigram")).groupBy("trigram").agg(F.count("*").alias("n"))


_SINGLE = f"d AS (SELECT DISTINCT doc_id, unnest(w) AS w FROM t), x AS (SELECT doc_id, w AS token, unnest(list_distinct(list_concat([w], coalesce(synonyms, [])))) AS w FROM d LEFT JOIN syn ON d.w = syn.word), u AS (SELECT doc_id, w AS feature, CASE WHEN w = token THEN 1.0 ELSE 0.5 END::DOUBLE AS weight FROM x UNION ALL SELECT doc_id, {_STEM}, CASE WHEN w = token THEN 1.0 ELSE 0.5 END FROM x), s AS (SELECT doc_id, feature, max(weight) AS weight FROM u GROUP BY ALL)"


@family.query(f"WITH {_T}, {_GROUPS}, {_SINGLE}, p AS (SELECT doc_id, unnest(list_zip(w[:-2], w[2:])) AS p FROM t), i AS (SELECT doc_id, s, unnest(range(1, length(s) - 1)) AS k FROM (SELECT doc_id, array_to_string(w, '') AS s FROM t)), f AS (SELECT * FROM s UNION ALL SELECT doc_id, p[1] || '_' || p[2], 0.5::DOUBLE FROM p UNION ALL SELECT doc_id, '_tri_' || substr(s, k, 3), 0.08::DOUBLE FROM i WHERE regexp_full_match(substr(s, k, 3), '[a-z]{{3}}')) SELECT feature, count(DISTINCT doc_id) AS n_docs, round(sum(weight), 4) AS weight FROM f GROUP BY feature")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = encode.features(table(spark, sf_dir, "documents"), "doc_id", "text")
    return f.groupBy("feature").agg(F.count("*").alias("n_docs"), F.round(F.sum("weight"), 4).alias("weight"))


@family.query("SELECT doc_id, ('0x' || substr(sha256(text), 1, 16))::UBIGINT::VARCHAR AS seed FROM documents")
def text_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.seed(F.col("text")).cast("string").alias("seed"))


@family.query("SELECT doc_id, i AS pos, md5(substr(text, (i + 1)::INT, 500)) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 400)) AS i FROM documents) WHERE length(regexp_replace(substr(text, (i + 1)::INT, 500), '^\\s+|\\s+$', '', 'g')) > 50")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.chunks(F.col("text"))).alias("c"))
    return c.select("doc_id", F.col("c.pos").cast("long").alias("pos"), F.md5("c.chunk").alias("chunk"))


@family.query("SELECT lang, sum(length(text))::BIGINT AS n_chars, sum(length(text) // 4)::BIGINT AS n_tokens FROM documents GROUP BY lang")
def estimated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.length("text")).alias("n_chars"), F.sum(tx.estimated_tokens(F.col("text"))).alias("n_tokens"))


_MD = r"m AS (SELECT doc_id, '# ' || source || E'\n' || text || E'\n## End of ' || lang || E'\nlast line\n' AS text FROM documents)"


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("# "), "source", F.lit("\n"), "text", F.lit("\n## End of "), "lang", F.lit("\nlast line\n")).alias("text"))


@family.query(rf"WITH {_MD}, s AS (SELECT doc_id, text, regexp_extract_all(text, '(?m)^#{{1,3}}[ ]+(.+)$', 1)[:20] AS titles FROM m), e AS (SELECT doc_id, text, unnest(titles) AS title, generate_subscripts(titles, 1) - 1 AS pos FROM s) SELECT doc_id, pos, title, left(regexp_replace(lower(trim(title)), '[^a-z0-9]', '_', 'g'), 40) AS section_id FROM e")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _markdown(spark, sf_dir).select("doc_id", F.posexplode(extract.titles(F.col("text"))).alias("pos", "title"))
    return e.select("doc_id", F.col("pos").cast("long").alias("pos"), "title", tx.section_id(F.col("title")).alias("section_id"))


@family.query(r"WITH c AS (SELECT doc_id, unnest(list_transform(list_filter(list_transform(string_split(replace(text, E'\n', E'\n# '), E'\n'), lambda x: trim(x)), lambda x: starts_with(x, '#')), lambda x: regexp_replace(x, '^[#/]+\s*', ''))) AS c FROM documents) SELECT doc_id, count(*) AS n, md5(string_agg(c, '|' ORDER BY c)) AS lines FROM c WHERE length(c) > 10 GROUP BY doc_id")
def comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", tx.comments(F.replace("text", F.lit("\n"), F.lit("\n# "))).alias("c"))
    return d.where(F.size("c") > 0).select("doc_id", F.size("c").cast("long").alias("n"), F.md5(F.array_join(F.sort_array("c"), "|")).alias("lines"))


@family.query(r"SELECT doc_id, left(trim(f, '#/.*'), 150) AS line FROM (SELECT doc_id, list_filter(list_transform(string_split(text, E'\n')[:10], lambda x: trim(x)), lambda x: trim(x, '#/.*') <> '' AND length(x) > 10)[1] AS f FROM documents)")
def first_informative_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", extract.first_informative_line(F.col("text")).alias("line"))


@family.query("SELECT p_partkey, left(CASE WHEN starts_with(own, 'part') THEN own ELSE 'part_' || own END, 60) AS id FROM (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') AS own FROM part)")
def make_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.make_id(F.concat_ws(" ", "p_name", "p_type"), F.lit("part")).alias("id"))




@family.query("""WITH u AS (SELECT p_partkey, 'parts/p' || p_partkey || '.py' AS source, 'p' || p_partkey AS m, 'Part' || p_partkey AS c, p_name, p_type FROM part) SELECT 'module_' || m AS id, p_name AS content, source FROM u UNION ALL SELECT m || '_' || c, p_type, source FROM u UNION ALL SELECT m || '_' || c || '.show', 'Method ''show'' of ''' || c || '''', source FROM u UNION ALL SELECT m || '_note_0', 'a comment that is kept', source FROM u""")
def extract_python_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a small Python file."""
    key = F.col("p_partkey").cast("string")
    code = F.concat(
        F.lit('"""'), "p_name", F.lit('"""\nimport os\n\n# a comment that is kept\nclass Part'), key, F.lit(':\n    """'), "p_type", F.lit('"""\n\n    def show(self):\n        return 1\n\n    def _hidden(self):\n        return 2\n'),
    )
    f = dealt(spark, sf_dir, "part", "p_partkey").select(F.concat(F.lit("parts/p"), key, F.lit(".py")).alias("path"), code.alias("text"))
    return extract.units(f).select("id", "content", "source")


@family.query("""WITH u AS (SELECT 'src/p' || p_partkey || '.go' AS source, 'p' || p_partkey AS m, 'Part' || p_partkey AS c FROM part) SELECT 'module_' || m AS id, 'Go file ' || source AS content, source FROM u UNION ALL SELECT m || '_' || c || '.Show', 'Function ''' || c || '.Show'' in ' || source, source FROM u UNION ALL SELECT m || '_main', 'Function ''main'' in ' || source, source FROM u UNION ALL SELECT m || '_' || c, 'Type ''' || c || ''' in ' || source, source FROM u""")
def extract_go_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a small Go file."""
    key = F.col("p_partkey").cast("string")
    code = F.concat(F.lit("package p\n\ntype Part"), key, F.lit(" struct {\n}\n\nfunc (p *Part"), key, F.lit(") Show() {\n}\n\nfunc main() {\n}\n"))
    f = dealt(spark, sf_dir, "part", "p_partkey").select(F.concat(F.lit("src/p"), key, F.lit(".go")).alias("path"), code.alias("text"))
    return extract.units(f).select("id", "content", "source")


#: suffix, title, code before the key, code after it, and what the key's and the other name are.
_CODE = (
    (".ts", "Module", "export class Part", " {}\nexport async function show() {}\nconst add = (a) => a\n", ("Function show", "Function add", "Class Part+")),
    (".java", "Java class", "public class Part", " {\n  public int show() {\n    return 1;\n  }\n}\n", ("Class Part+", "Method show")),
    (".rs", "Rust module", "pub struct Part", ";\npub fn show() {}\n", ("Function show", "Type Part+")),
    (".cs", "C# file", "record Part", ";\n", ("Class Part+",)),
    (".cpp", "C/C++ file", "int part", "(int a) {\n  return a;\n}\n", ("Function part+",)),
    (".rb", "Ruby file", "module Part", "\n  def self.show?\n  end\nend\n", ("Class Part+", "Method show?")),
    (".php", "PHP file", "class Part", " {\n  function show() {}\n}\n", ("Class Part+", "Function show")),
    (".kt", "Kotlin file", "object Part", " {\n  fun show() = 1\n}\n", ("Class Part+", "Function show")),
    (".swift", "Swift file", "protocol Part", " {\n  func show()\n}\n", ("Type Part+", "Function show")),
)


def _code_sql() -> str:
    out = []
    for suffix, title, _, _, named in _CODE:
        source, module = f"'src/p' || p_partkey || '{suffix}'", "'p' || p_partkey"
        out.append(f"SELECT 'module_' || {module} AS id, '{title} ' || {source} AS content, {source} AS source FROM part")
        for what, name in (x.split(" ") for x in named):
            name = f"'{name[:-1]}' || p_partkey" if name.endswith("+") else f"'{name}'"
            out.append(f"SELECT {module} || '_' || {name}, '{what} ''' || {name} || ''' in ' || {source}, {source} FROM part")
    return " UNION ALL ".join(out)


@family.query(_code_sql())
def extract_code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a small file in each of the languages that patterns read."""
    key = F.col("p_partkey").cast("string")
    files_ = F.array(*[F.struct(F.concat(F.lit("src/p"), key, F.lit(suffix)).alias("path"), F.concat(F.lit(before), key, F.lit(after)).alias("text")) for suffix, _, before, after, _ in _CODE])
    return extract.units(dealt(spark, sf_dir, "part", "p_partkey").select(F.explode(files_).alias("f")).select("f.*")).select("id", "content", "source")


@family.query("""WITH u AS (SELECT 'web/p' || p_partkey || '.ts' AS source, 'p' || p_partkey AS src FROM part) SELECT src, 'date_tools' AS tgt, 'imports' AS rel_type, source FROM u UNION ALL SELECT src, 'fs', 'imports', source FROM u UNION ALL SELECT src, 'json', 'imports', replace(source, '.ts', '.py') FROM u UNION ALL SELECT src, 'os', 'imports', replace(source, '.ts', '.py') FROM u""")
def import_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The imports of every part's script and Python file."""
    key = F.col("p_partkey").cast("string")
    ts = F.lit("import 'lib/date-tools.js'\nconst fs = require('fs')\n")
    py = F.lit("import json\n\ndef f():\n    from os.path import join\n")
    files_ = F.array(*[F.struct(F.concat(F.lit("web/p"), key, F.lit(x)).alias("path"), text.alias("text")) for x, text in ((".ts", ts), (".py", py))])
    return extract.relations(dealt(spark, sf_dir, "part", "p_partkey").select(F.explode(files_).alias("f")).select("f.*")).select("src", "tgt", "rel_type", "source")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, (".py", ".MD", ".png", ".env", ".tar.gz"))), (F.col("page_id") % 5 + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, ("src", "build", ".git", "a/rebuild"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(folder, F.lit("/f"), F.col("page_id").cast("string"), kind).alias("path"))


_PATHS = "p AS (SELECT page_id, ['src', 'build', '.git', 'a/rebuild'][page_id % 4 + 1] AS folder, ['.py', '.MD', '.png', '.env', '.tar.gz'][page_id % 5 + 1] AS kind FROM pages), f AS (SELECT page_id, folder || '/f' || page_id || kind AS path, folder, kind FROM p)"


@family.query(f"WITH {_PATHS} SELECT page_id, path, kind IN ('.py', '.MD') AS known, folder IN ('build', '.git') AS pruned, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS suffix, 'f' || page_id || CASE WHEN kind = '.tar.gz' THEN '.tar' ELSE '' END AS stem FROM f")
def file_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _paths(spark, sf_dir).select("page_id", "path", files.known_suffix(path).alias("known"), files.pruned(path).alias("pruned"), tx.path_suffix(path).alias("suffix"), tx.path_stem(path).alias("stem"))


@family.query(f"WITH {_PATHS} SELECT page_id FROM f WHERE NOT contains(path, 'build')")
def gitignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.not_ignored(_paths(spark, sf_dir), spark.createDataFrame([("build/",), ("# note",), ("",)], "pattern string")).select("page_id")


@family.query("SELECT doc_id, md5(text) AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))


@family.query("SELECT 'Commit ' || conv_id || ' by ' || min_by(role, turn) || ': ' || min_by(text, turn) || '. Files changed: ' || array_to_string(list(turn ORDER BY turn)[:10], ', ') AS content, 'git:' || conv_id AS source FROM conversations GROUP BY conv_id")
def commit_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("author"), F.min_by("text", "turn").alias("message"), F.transform(F.sort_array(F.collect_list("turn")), lambda t: t.cast("string")).alias("files"))
    return files.commits(c.withColumn("hash", F.col("conv_id").cast("string")))


@family.query("SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def section_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")).alias("previous"))


@family.query("SELECT conv_id || '_' || turn AS source, role AS concept, text AS intention FROM conversations")
def distill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, with its whole text, as a language model's reply."""
    text = F.to_json(F.struct(F.array(F.struct(F.col("role").alias("concept"), F.col("text").alias("intention"))).alias("units")))
    source = F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("source")
    replies = table(spark, sf_dir, "conversations").select(source, F.concat(F.lit("```json\n"), text, F.lit("\n```")).alias("reply"))
    return files.distilled(replies).select("source", "concept", "intention")
