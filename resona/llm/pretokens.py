"""Splitting texts as byte-level tokenizers do.

The split is cheap in the standard library's ``re`` over characters whose
Unicode classes are the same everywhere; texts with others are split by the
tokenizer library's own pre-tokenizer, so that both know the same Unicode.
"""

from __future__ import annotations

import re
from functools import cache

_LETTERS = "a-zA-Zªµºß-öø-ÿÀ-ÖØ-ÞĀ-ſ"
_DIGITS = "0-9²³¹¼-¾"
_SPACES = r"\t\n\x0b\x0c\r \x85\xa0"
#: Characters beyond those for which the classes above are complete.
UNUSUAL = re.compile(r"[^\t-\r\x20-\x7e\x85\xa0-ſ‐-‧]")
_COMMON = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACES}{_LETTERS}{_DIGITS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
#: White space before a space, and a space at the end: there a space need not begin a match.
_JOINED = re.compile(rf"[{_SPACES}] | \Z")
#: Before a single space between two characters that are not white space.
_SINGLE = re.compile(r"(?<=\S)(?= \S)")


@cache
def _library():
    from tokenizers import pre_tokenizers

    return pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def split(text: str) -> list[str]:
    """The matches of the byte-level tokenizers' pattern; together they are the text."""
    if UNUSUAL.search(text):
        return [text[a:b] for _, (a, b) in _library().pre_tokenize_str(text)]
    return _COMMON.findall(text)


def chunks(text: str) -> list[str]:
    """Parts of the text across whose borders the pattern never matches: a few matches each, often repeated.

    A space between two characters that are not white space always begins a
    match, so texts in which all spaces are such are split there quickly.
    """
    if _JOINED.search(text) or UNUSUAL.search(text):
        return _SINGLE.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]
