"""Search in texts: vocabulary, word correction, relevance, snippets and matching lines."""

from __future__ import annotations

import dataclasses
import operator
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.distance import budget, osa_within
from spindrift.functions.folding import folded
from spindrift.plans.grammar import Leaf, Query, smart_case
from spindrift.plans.definitions import definition_line
from spindrift.plans.predicates import Compiler
from spindrift.session import written

#: Extensions of headers.
HEADERS = ["h", "hh", "hpp", "hxx"]
#: Respelt queries that are tried.
TRIALS = 4
#: Words that one misspelt word may stand for; characters of a snippet and before its match; bytes of a line that is shown.
EXPANSIONS, SNIPPET, BEFORE, LINE = 64, 200, 60, 500
WORD = r"[A-Za-z0-9_\u0080-￿]+"


def vocabulary(entries: DataFrame) -> DataFrame:
    """Words of all texts: term, tf (occurrences), df (texts)."""
    words = (
        entries.where("text is not null").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), F.lit(1))).alias("term"), "path")
    )
    return words.groupBy("term", "path").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def near_words(entries: DataFrame, word: str, most: int | None = None, words: DataFrame | None = None) -> DataFrame:
    """Words of the texts within an edit distance of a word, most frequent first: term, df, distance.

    ``words`` is a vocabulary that was written before; without one the texts are read. A swap of letters costs two
    plain edits, so what is further away by plain edits is left out before Python sees it.
    """
    most = budget(word, content=True) if most is None else most
    known = vocabulary(entries) if words is None else words
    close = known.where((F.abs(F.length("term") - len(word)) <= most) & (F.levenshtein("term", F.lit(word), 2 * most) >= 0))
    return (
        close.withColumn("distance", osa_within(F.col("term"), word, most))
            .where(F.col("distance") <= most)
            .select("term", "df", "distance")
            .orderBy(F.desc("df"), "term")
            .limit(EXPANSIONS)
    )


def expand(entries: DataFrame, q: Query, words: DataFrame | None = None) -> Query:
    """``content~`` leaves with the words they stand for; a bounded number of words is read to the driver."""
    if not any(x.of("vocabulary") for x in q.queries()):
        return q
    out = dataclasses.replace(q, leaves=[])
    for leaf in q.leaves:
        if leaf.kind == "vocabulary" and not isinstance(leaf.value, list):
            word, most = leaf.value
            leaf = Leaf("vocabulary", [r["term"] for r in near_words(entries, word.lower(), most, words).collect()], leaf.exact_case)
        elif leaf.kind == "any":
            leaf = Leaf("any", [expand(entries, x, words) for x in leaf.value])
        elif leaf.kind == "not":
            leaf = Leaf("not", expand(entries, leaf.value, words))
        out.leaves.append(leaf)
    return out


def corrected(entries: DataFrame, word: str, words: DataFrame | None = None) -> DataFrame:
    """What a word of four letters or more that no text holds may have meant: term, distance, df, best first."""
    return near_words(entries, word.lower(), None, words).where(F.col("distance") > 0).orderBy("distance", F.desc("df"), "term")


def respellings(entries: DataFrame, q: Query, words: DataFrame | None = None) -> list[Query]:
    """Queries to try when a query on texts found nothing: words that no text holds, replaced by near ones.

    Words of four letters or more, without regard to case, in top-level word and phrase leaves; at most ``TRIALS``:
    each word by its best, all of them, then each by its second best. Queries with case have none.
    """
    if q.exact_case or smart_case(q):
        return []
    asked = list(dict.fromkeys(w for x in q.of("content") for w in re.findall(r"\w{4,}", x.value.lower())))
    if not asked:
        return []
    known = written(vocabulary(entries), "words")[0] if words is None else words
    near = None
    for w in asked:  # one job for all words: the vocabulary is read once a word, not the texts
        part = near_words(entries, w, None, known).select(F.lit(w).alias("w"), "term", "df", "distance")
        near = part if near is None else near.unionByName(part)
    found: dict[str, list[tuple]] = {w: [] for w in asked}
    for r in near.collect():  # EXPANSIONS rows a word at most
        found[r["w"]].append((r["distance"], -r["df"], r["term"]))
    best = {w: [t for _, _, t in sorted(x)][:2] for w, x in found.items() if x and min(x)[0] > 0}

    def put(change: dict[str, str]) -> Query:
        again = lambda text: re.sub(r"\w+", lambda m: change.get(m.group().lower(), m.group()), text)
        return dataclasses.replace(
            q, leaves=[Leaf("content", again(x.value), x.exact_case, x.quoted) if x.kind == "content" else x for x in q.leaves]
        )

    trials = [{w: x[0]} for w, x in best.items()]
    trials += [{w: x[0] for w, x in best.items()}] if len(best) > 1 else []
    trials += [{w: x[1]} for w, x in best.items() if len(x) > 1]
    return [put(t) for t in trials[:TRIALS]]


def promotion(q: Query) -> str | None:
    """SQL for the tier of a file's name, for a query on texts that names one symbol (or consists of patterns): headers
    named after it 0, other files named after it 1, the rest 2. None for other queries."""
    symbols = [x.value for x in _positive(q) if x.kind in ("content", "symbol") and re.fullmatch(r"[A-Za-z_]\w*", x.value)]
    header = f"ext_l in ({', '.join(map(repr, HEADERS))})"
    if len(symbols) == 1 and len(key := re.sub(r"[_-]", "", symbols[0]).lower()) >= 3 and key.isascii():
        named = f"translate(substring_index(name_l, '.', 1), '_-', '') = '{key}'"
        return f"case when {named} and {header} then 0 when {named} then 1 else 2 end"
    leaves = _positive(q)
    if leaves and all(x.kind == "content_regex" for x in leaves) and not q.exact_case:
        named = " or ".join(f"name rlike {_literal('(?i)' + x.value)}" for x in leaves)
        return f"case when ({named}) and {header} then 0 when {named} then 1 else 2 end"
    return None


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _positive(q: Query) -> list[Leaf]:
    out = [x for x in q.leaves if x.kind in ("content", "content_regex", "symbol", "vocabulary")]
    for leaf in q.of("any"):
        for x in leaf.value:
            out += _positive(x)
    return out


def _place(leaf: Leaf, smart: bool) -> Column:
    """Where a leaf first matches, from 1; 0 if nowhere."""
    if leaf.kind == "content":
        return F.locate(leaf.value, F.col("text")) if smart or leaf.exact_case else F.locate(leaf.value.lower(), F.lower("text"))
    if leaf.kind == "symbol":
        return F.locate(leaf.value, F.col("text"))
    return F.lit(0)


def _defines(name: str) -> Callable[[Column], Column]:
    return lambda line: definition_line(line, name)


def relevance(rows: DataFrame, q: Query) -> DataFrame:
    """Adds relevance (matching leaves, a definition counts as one more), tier (named after the symbol: header 0, other 1, rest 2) and first_at."""
    smart = smart_case(q)
    leaves, compiler = _positive(q), Compiler(set(rows.columns), smart=smart)
    if any(x.kind == "content" for x in leaves) and "text_f" not in rows.columns:
        rows = rows.withColumn("text_f", folded(F.col("text")))
    score, tier, first = F.lit(0), F.lit(2), None
    for leaf in leaves:
        score = score + F.when(compiler.leaf(q, leaf), 1).otherwise(0)
        at = _place(leaf, smart)
        first = F.when(at > 0, at) if first is None else F.least(first, F.when(at > 0, at))
        word = leaf.value if isinstance(leaf.value, str) else ""
        if word.replace("_", "").isalnum():
            score = score + F.when(F.exists(F.split("text", "\n"), _defines(word)), 1).otherwise(0)
            stem = F.translate(F.substring_index("name_l", ".", 1), "_-", "")
            named = stem == word.lower().replace("_", "")
            tier = F.least(tier, F.when(named & F.col("ext_l").isin(HEADERS), 0).when(named, 1).otherwise(2))
    return (
        rows.withColumn("relevance", F.coalesce(score, F.lit(0)))
            .withColumn("tier", tier)
            .withColumn("first_at", F.coalesce(first if first is not None else F.lit(None), F.lit(1 << 30)))
    )


def snippet(q: Query, smart: bool = False) -> Column:
    """Up to 200 characters around the first match of the first word or phrase that matches; empty for patterns only."""
    out = F.lit("")
    for leaf in reversed([x for x in _positive(q) if x.kind in ("content", "symbol")]):
        at = _place(leaf, smart)
        start = F.greatest(F.lit(1), at - BEFORE)
        cut = F.translate(F.substring(F.col("text"), start, F.lit(SNIPPET)), "\r\n\t", "   ")
        shown = F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(start + SNIPPET - 1 < F.length("text"), "...").otherwise(""))
        out = F.when(at > 0, shown).otherwise(out)
    return F.coalesce(out, F.lit(""))


def _shown(text: str) -> Column:
    """A line, cut behind the last whole character within ``LINE`` bytes if it has more."""
    raw = F.encode(F.col(text), "UTF-8")
    cut = F.lit(LINE - 3)
    for n in (LINE - 2, LINE - 1, LINE):
        cut = F.when(F.hex(F.substring(raw, n + 1, 1)).rlike("^[89AB]"), cut).otherwise(n)
    return F.when(F.octet_length(text) > LINE, F.concat(F.decode(F.substring(raw, F.lit(1), cut), "UTF-8"), F.lit("…"))).otherwise(F.col(text))


def lines(rows: DataFrame, q: Query, before: int = 0, after: int = 0, most: int = 0) -> DataFrame:
    """Matching lines with their neighbours: path, line (from 1), text, match; ``most`` limits the matches of a file.

    A file's lines are in order already, so neighbours are picked inside its row, and nothing is shuffled.
    """
    smart, leaves = smart_case(q), _positive(q)
    hit = lambda line: reduce(operator.or_, [Compiler({"text"}, smart=smart, text=line).leaf(q, x) for x in leaves], F.lit(False))
    split = rows.where("text is not null").select("path", "ext_l", F.split("text", "\r?\n").alias("_l"))
    split = split.withColumn("_h", F.transform("_l", hit))
    split = split.withColumn("_m", F.filter(F.transform("_h", lambda h, i: F.when(h, i)), lambda i: i.isNotNull())).where(F.size("_m") > 0)
    if most > 0:
        split = split.withColumn("_m", F.slice("_m", 1, most))
    last = F.element_at("_m", -1)
    near = (
        F.flatten(F.transform("_m", lambda i: F.sequence(F.greatest(F.lit(0), i - before), F.least(F.size("_l") - 1, i + after))))
        if before or after
        else F.col("_m")
    )
    shown = F.transform(
        F.array_distinct(near), lambda i: F.struct(i.alias("i"), F.get("_l", i).alias("text"), (F.get("_h", i) & (i <= last)).alias("match"))
    )
    return (
        split.select("path", F.explode(shown).alias("_s"))
            .select("path", (F.col("_s.i") + 1).alias("line"), F.col("_s.text").alias("text"), F.col("_s.match").alias("match"))
            .withColumn("text", _shown("text"))
    )
