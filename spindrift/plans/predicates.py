"""Conditions as columns: every leaf of a query becomes one boolean column that is never null.

Cheap conditions on short columns come first in the conjunction, patterns and text last.
"""

from __future__ import annotations

import operator
import re
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.folding import fold, folded
from spindrift.plans import globs
from spindrift.plans.definitions import definition_line
from spindrift.plans.grammar import Leaf, Query, QueryError, smart_case

_COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "=": operator.eq}
_COST = {
    k: i
    for i, k in enumerate("volume kind ext attributes size when after parent in equals starts ends git term dir glob path_glob any not regex symbol content content_regex".split())
}
_NEEDS = {
    "size": "size", "when": "mod_ns", "after": "mod_ns", "attributes": "mode", "content": "text", "content_regex": "text", "symbol": "text",
    "git": "git"
}


class Compiler:
    """Columns for the leaves of a query; ``has`` names the optional columns that the entries carry."""

    def __init__(self, has: set[str], features: dict[str, Callable[[str], Column]] | None = None, smart: bool = False, text: Column | None = None):
        self.has, self.features, self.smart = has, features or {}, smart
        self.text, self.text_f = (F.col("text"), F.col("text_f")) if text is None else (text, folded(text))

    def query(self, q: Query) -> Column:
        if q.impossible:
            return F.lit(False)
        parts = [(x.kind, self.leaf(q, x)) for x in q.leaves]
        if q.kind:
            parts.append(("kind", F.col("is_dir") if q.kind == "dir" else ~F.col("is_dir")))
        parts.sort(key=lambda p: _COST.get(p[0], 99))
        return reduce(operator.and_, [c for _, c in parts], F.lit(True))

    def leaf(self, q: Query, leaf: Leaf) -> Column:
        need = _NEEDS.get(leaf.kind)
        if need and need not in self.has:
            raise QueryError(f"the entries have no {need}")
        return F.coalesce(getattr(self, "do_" + leaf.kind)(q, leaf), F.lit(False))

    def _text(self, q: Query, leaf: Leaf, what: str, test: Callable[[Column, str], Column]) -> Column:
        """A test on a name or path: as it is with case, else lower-case, and once more without marks unless quoted."""
        if q.exact_case:
            return test(F.col(what), leaf.value)
        plain = test(F.col(f"{what}_l"), leaf.value)
        return plain if leaf.quoted else plain | test(F.col(f"{what}_f"), fold(leaf.value))

    def do_term(self, q: Query, leaf: Leaf) -> Column:
        return self._text(q, leaf, "path" if q.path_mode else "name", lambda c, v: c.contains(v))

    def do_equals(self, q: Query, leaf: Leaf) -> Column:
        return self._text(q, leaf, "name", lambda c, v: c == v)

    def do_starts(self, q: Query, leaf: Leaf) -> Column:
        return self._text(q, leaf, "name", lambda c, v: c.startswith(v))

    def do_ends(self, q: Query, leaf: Leaf) -> Column:
        return self._text(q, leaf, "name", lambda c, v: c.endswith(v))

    def do_dir(self, q: Query, leaf: Leaf) -> Column:
        return self._text(q, leaf, "path", lambda c, v: c.contains(v.replace("/", "\\")))

    def do_volume(self, q: Query, leaf: Leaf) -> Column:
        return F.upper("volume") == leaf.value

    def do_ext(self, q: Query, leaf: Leaf) -> Column:
        return F.col("ext_l") == leaf.value

    def do_parent(self, q: Query, leaf: Leaf) -> Column:
        return F.col("parent_l") == leaf.value.lower()

    def do_in(self, q: Query, leaf: Leaf) -> Column:
        return (F.col("path_l") == leaf.value) | F.col("path_l").startswith(leaf.value + "\\")

    def do_size(self, q: Query, leaf: Leaf) -> Column:
        return _COMPARE[leaf.value[0]](F.col("size"), leaf.value[1])

    def do_when(self, q: Query, leaf: Leaf) -> Column:
        low, high = leaf.value
        known = (F.col("mod_ns") != 0) & (F.col("mod_ns") >= low)
        return known if high is None else known & (F.col("mod_ns") < high)

    def do_after(self, q: Query, leaf: Leaf) -> Column:
        return (F.col("mod_ns") != 0) & (F.col("mod_ns") > leaf.value)

    def do_attributes(self, q: Query, leaf: Leaf) -> Column:
        return F.col("mode").bitwiseAND(F.lit(leaf.value)) == leaf.value

    def do_glob(self, q: Query, leaf: Leaf) -> Column:
        if (exts := globs.plain_extensions(leaf.value)) and not q.exact_case:
            return F.col("ext_l").isin([x.lower() for x in exts])
        column, flag = (F.col("name"), "") if q.exact_case else (F.col("name_l"), "")
        return reduce(operator.or_, [column.rlike(flag + globs.name_regex(p if q.exact_case else p.lower())) for p in globs.braces(leaf.value)])

    def do_path_glob(self, q: Query, leaf: Leaf) -> Column:
        slashed = F.translate("path" if q.exact_case else "path_l", "\\", "/")
        return reduce(operator.or_, [slashed.rlike(globs.path_regex(p if q.exact_case else p.lower())) for p in globs.braces(leaf.value)])

    def do_regex(self, q: Query, leaf: Leaf) -> Column:
        found = F.col("path").rlike(leaf.value if q.exact_case else "(?i)" + leaf.value)
        for literal in required_literals(leaf.value) if not q.exact_case else []:
            found = F.col("path_l").contains(literal) & found
        return found

    def do_git(self, q: Query, leaf: Leaf) -> Column:
        classes = [c for x in q.of("git") for c in x.value]  # several git: add up
        flags = [F.coalesce(F.col(f"git.{c}"), F.lit(False)) for c in dict.fromkeys(classes)]
        return reduce(operator.or_, flags)

    def do_any(self, q: Query, leaf: Leaf) -> Column:
        return reduce(operator.or_, [self.query(x) for x in leaf.value])

    def do_not(self, q: Query, leaf: Leaf) -> Column:
        return ~self.query(leaf.value)

    def do_feature(self, q: Query, leaf: Leaf) -> Column:
        name, term = leaf.value
        if name not in self.features:
            raise QueryError(f"no companion {name}")
        return self.features[name](term)

    def do_content(self, q: Query, leaf: Leaf) -> Column:
        if q.exact_case or self.smart:
            return self.text.contains(leaf.value)
        needle, low = leaf.value.lower(), F.lower(self.text)
        if fold(needle) == needle:
            return low.contains(needle) | self.text_f.contains(needle)
        return low.contains(unicodedata.normalize("NFC", needle)) | low.contains(unicodedata.normalize("NFD", needle))

    def do_content_regex(self, q: Query, leaf: Leaf) -> Column:
        anchored = re.search(r"(?<!\\)[\^$]", re.sub(r"\[[^\]]*\]", "", leaf.value)) is not None
        flags = ("" if q.exact_case or self.smart else "i") + ("m" if anchored else "")
        text = F.regexp_replace(self.text, "\r\n", "\n") if anchored else self.text
        return text.rlike((f"(?{flags})" if flags else "") + leaf.value)

    def do_vocabulary(self, q: Query, leaf: Leaf) -> Column:
        """Expanded before compiling to the words found in the texts (``content.expand``); unexpanded it is the word itself."""
        words = leaf.value if isinstance(leaf.value, list) else [leaf.value[0].lower()]
        if not words:
            return F.lit(False)
        return F.lower(self.text).rlike(r"(?<![\w])(?:" + "|".join(re.escape(w) for w in words) + r")(?![\w])")

    def do_symbol(self, q: Query, leaf: Leaf) -> Column:
        return self.text.contains(leaf.value) & F.exists(F.split(self.text, "\r?\n"), lambda line: definition_line(line, leaf.value))


def required_literals(pattern: str) -> list[str]:
    """Lower-case literals of three letters at least that any match holds: a cheap condition before the pattern."""
    if re.search(r"[|(\[{]|\\[^.\\]", pattern):
        return []
    out = []
    for run in re.split(r"\.[*+?]*|\^|\$", re.sub(r"\\\.", "\0", pattern)):
        run = re.sub(r".[*?]|\+", "\1", run)
        out += [p.replace("\0", ".").lower() for p in run.split("\1") if len(p) >= 3 and p.isascii()]
    return out


def compile_query(q: Query, has: set[str], features: dict[str, Callable[[str], Column]] | None = None) -> Column:
    return Compiler(has, features, smart_case(q)).query(q)
