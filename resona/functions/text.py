"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in the order in which they are tried.
SUFFIXES = (
    "ation", "tion", "sion", "ment", "ness", "ence", "ance",
    "able", "ible", "ful", "less", "ous", "ive", "ing",
    "ated", "ized", "ised", "ting", "ted", "ied", "ies",
    "ers", "est", "ity", "ism", "ist", "ent", "ant",
    "ion", "ory", "ary", "ery", "ure", "age",
    "ly", "ed", "er", "es", "al", "ic",
)


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, two characters at least."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)


def word_set(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits of the lower-cased text."""
    return F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+"))


def identifier_words(name: Column) -> Column:
    """The words of a snake_case, kebab-case or camelCase name; single letters go."""
    spaced = F.regexp_replace(F.regexp_replace(name, "[-_]", " "), "([A-Z])", " $1")
    return F.transform(F.filter(F.split(spaced, "\\s+"), lambda w: F.length(w) >= 2), F.lower)


def stem(word: Column) -> Column:
    """The word without the first suffix in order that leaves three characters; words of up to four stay."""
    out = word
    for suffix in reversed(SUFFIXES):
        out = F.when(F.endswith(word, F.lit(suffix)) & (F.length(word) - len(suffix) >= 3), F.substring(word, F.lit(1), F.length(word) - len(suffix))).otherwise(out)
    return F.when(F.length(word) <= 4, word).otherwise(out)


def stemmed(word: str) -> str:
    """``stem`` of one word in plain Python."""
    return word if len(word) <= 4 else next((word[: -len(s)] for s in SUFFIXES if word.endswith(s) and len(word) - len(s) >= 3), word)


def bigrams(words: Column) -> Column:
    """Neighbouring words, joined by an underscore."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def trigrams(words: Column) -> Column:
    """Every three neighbouring letters of the joined words, across their borders."""
    return F.regexp_extract_all(F.array_join(words, ""), F.lit("(?=([a-z]{3}))"), F.lit(1))


def seed(text: Column) -> Column:
    """The first 64 bits of the SHA-256, unsigned."""
    return F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def make_id(name: Column, module: Column) -> Column:
    """A node id: lower case, other characters as single underscores, under its module, 60 characters at most."""
    own = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
    # bound, so that it is not made for each use
    return F.element_at(F.transform(F.array(own), lambda o: F.substring(F.when(F.startswith(o, module), o).otherwise(F.concat_ws("_", module, o)), 1, 60)), 1)


def section_id(title: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.trim(title)), "[^a-z0-9]", "_"), 1, 40)


def path_stem(path: Column) -> Column:
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.when(F.regexp_like(name, F.lit("^.+\\.[^.]*$")), F.regexp_extract(name, "^(.+)\\.[^.]*$", 1)).otherwise(name)


def path_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "[^/](\\.[^./]+)$", 1))


def comments(text: Column) -> Column:
    """Lines that begin with # or //, without the marks, if longer than ten characters."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))
    marked = F.filter(lines, lambda x: F.startswith(x, F.lit("#")) | F.startswith(x, F.lit("//")))
    return F.filter(F.transform(marked, lambda x: F.regexp_replace(x, "^[#/]+\\s*", "")), lambda x: F.length(x) > 10)


def chunks(text: Column, size: int = 500, stride: int = 400, least: int = 50) -> Column:
    """Overlapping windows of the text that hold more than so many characters when trimmed: pos, chunk."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    each = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.substring(text, i + 1, F.lit(size)).alias("chunk")))
    return F.filter(each, lambda c: F.length(F.regexp_replace(c["chunk"], "^\\s+|\\s+$", "")) > least)


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)
