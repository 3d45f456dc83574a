"""Folding of text for comparison: case, marks, width and punctuation."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def marks() -> tuple[str, str]:
    """Letters with marks and their bare lower-case letters, by rule: what canonical decomposition leaves without marks."""
    old, new = [], []
    for i in range(0x80, min(sys.maxunicode, 0x3100)):
        c = chr(i)
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != c and bare.isalpha():
            old.append(c)
            new.append(bare)
    return "".join(old), "".join(new)


def plain(text: Column) -> Column:
    """Whether a text is ASCII throughout, so that there are no marks or wide letters to fold."""
    return F.octet_length(text) == F.length(text)


def words_only(text: Column) -> Column:
    """Lower-case words with one space between them; marks and everything but letters and digits are dropped.

    Null stays null; a text without words becomes empty.
    """
    old, new = marks()
    marked = F.translate(F.lower(F.regexp_replace(text, r"\p{M}+", "")), old, new)
    bare = F.when(plain(text), F.lower(text)).otherwise(marked)
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def fold(text: str) -> str:
    """What ``folded`` does, for a literal."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in bare).lower()


def folded(text: Column) -> Column:
    """Lower case without marks, full-width forms as ASCII; null stays null."""
    old, new = marks()
    wide = "".join(chr(i) for i in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(i - 0xFEE0) for i in range(0xFF01, 0xFF5F))
    return F.lower(F.when(plain(text), text).otherwise(F.translate(F.regexp_replace(text, r"\p{M}+", ""), old + wide, new + narrow)))
