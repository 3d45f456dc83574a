"""Names with slips of the keys: closest stretch of every name, and queries rewritten when nothing matched."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.distance import best_window, budget, likely, osa_within
from spindrift.plans.grammar import Leaf, Query
from spindrift.plans.predicates import compile_query

#: Rewrites tried for a query of several terms, and spellings of one term.
TRIALS, VARIANTS = 6, 3


def letters(text: F.Column) -> F.Column:
    """A bit per letter a-z and digit: which stand in a text."""
    out = F.lit(0).cast("long")
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
        out = out.bitwiseOR(F.when(text.contains(c), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _mask(term: str) -> int:
    return sum(1 << i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789") if c in term)


def eligible(q: Query) -> bool:
    """Whether slips may be forgiven: one plain term on names, no case, path, content, alternatives, patterns or anchors."""
    plain = q.of("term")
    return (
        len(plain) == 1
        and not plain[0].quoted
        and not q.exact_case
        and not q.path_mode
        and budget(plain[0].value) > 0
        and not q.of("content", "content_regex", "any", "regex", "equals", "starts", "ends", "path_glob")
    )


def close_names(entries: DataFrame, q: Query) -> DataFrame:
    """Entries whose name comes close to the query's term, best first: adds dist, whole, at. Other conditions hold.

    Every name is looked at; names that lack more letters of the term than edits are allowed, or match no form of it
    that the edits leave, are left out before Python sees them, and distances are found once a distinct name.
    """
    term = q.of("term")[0].value
    most = budget(term)
    others = compile_query(dataclasses.replace(q, leaves=[x for x in q.leaves if x.kind != "term"]), set(entries.columns))
    kept = entries.where(others)
    lacking = F.bit_count(F.lit(_mask(term)).cast("long").bitwiseAND(F.bitwise_not(letters(F.col("name_f")))))
    names = kept.where(lacking <= most).where(F.col("name_f").rlike(likely(term, most))).select("name_f").distinct()
    near = names.withColumn("w", best_window(F.col("name_f"), term, most)).where(F.col("w.dist") <= most)
    near = near.select("name_f", F.col("w.dist").alias("dist"), F.col("w.at").alias("at"), F.levenshtein("name_f", F.lit(term)).alias("whole"))
    return kept.join(near, "name_f").orderBy("dist", "whole", (F.col("at") != 0).asc(), "at", F.abs(F.length("name_f") - len(term)), "name_l", "path")


def topped_up(entries: DataFrame, exact: DataFrame, q: Query, limit: int) -> DataFrame:
    """Exact results, then close ones that aren't among them, up to a limit; adds ``dist`` (0 for exact)."""
    if not eligible(q):
        return exact.withColumn("dist", F.lit(0))
    close = close_names(entries, q).join(exact.select("path"), "path", "left_anti").select(*entries.columns, "dist")
    return exact.select(*entries.columns, F.lit(0).alias("dist")).unionByName(close).orderBy("dist", "name_l", "path").limit(limit)


def name_words(entries: DataFrame) -> DataFrame:
    """Words of all names: word, n."""
    return (
        entries.select(F.explode(F.split("name_f", r"[^\p{L}\p{N}]+")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    )


def variants(entries: DataFrame, term: str, words: DataFrame | None = None) -> DataFrame:
    """Words of names near a term, by distance, then frequency: word, dist, n. ``words``: ``name_words`` written before."""
    most = budget(term)
    known = name_words(entries) if words is None else words
    near = (
        known.where((F.abs(F.length("word") - len(term)) <= most) & (F.levenshtein("word", F.lit(term), 2 * most) >= 0))
            .withColumn("dist", osa_within(F.col("word"), term, most))
    )
    return near.where((F.col("dist") > 0) & (F.col("dist") <= most)).select("word", "dist", "n").orderBy("dist", F.desc("n"), "word").limit(VARIANTS)


def rewritable(q: Query) -> bool:
    """Whether one of several terms may be respelt: no case, path, text, alternatives or patterns."""
    return (
        len(q.of("term")) > 1
        and not q.exact_case
        and not q.path_mode
        and not q.of("content", "content_regex", "vocabulary", "symbol", "any", "regex", "glob", "path_glob")
    )


def rewritten(entries: DataFrame, q: Query, words: DataFrame | None = None) -> tuple[Query, list[str]] | None:
    """A query of several terms that matches after one term is respelt, with its terms; None if no trial matches.

    Terms without any match are respelt first, shorter ones before longer. Three jobs whatever the number of trials:
    matches of the terms, spellings of all terms, matches of all trials.
    """
    terms = [x.value for x in q.of("term") if not x.quoted]
    has = set(entries.columns)
    asked = [i for i, t in enumerate(terms) if budget(t) > 0]
    if not asked:
        return None
    counts = entries.agg(*[F.count_if(F.col("name_f").contains(t)).alias(f"n{i}") for i, t in enumerate(terms)]).collect()[0]
    near = reduce(DataFrame.unionByName, [variants(entries, terms[i], words).select(F.lit(i).alias("i"), "word", "dist", "n") for i in asked])
    spelt = sorted(near.collect(), key=lambda r: (counts[f"n{r['i']}"] > 0, len(terms[r["i"]]), r["i"], r["dist"], -r["n"], r["word"]))[:TRIALS]  # VARIANTS rows a term
    trials = [
        dataclasses.replace(
            q, leaves=[Leaf("term", r["word"], x.exact_case) if x.kind == "term" and x.value == terms[r["i"]] else x for x in q.leaves]
        )
        for r in spelt
    ]
    return first_match(entries, trials, has)


def first_match(entries: DataFrame, trials: list[Query], has: set[str]) -> tuple[Query, list[str]] | None:
    """The first of some queries that matches anything, from one reading of the entries."""
    if not trials:
        return None
    found = entries.agg(*[F.max(compile_query(x, has)).alias(f"t{i}") for i, x in enumerate(trials)]).collect()[0]
    return next(((x, x.terms) for i, x in enumerate(trials) if found[f"t{i}"]), None)
