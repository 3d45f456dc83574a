"""The commands of a file search as plain calls over a catalogue: search, count, lines, content, content index, info, open, recent, watch, syntax."""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators import content, fuzzy, ranking, rollup
from spindrift.operators import search as searching
from spindrift.plans.grammar import SORTS, Query, QueryError, Settings, contents, parse
from spindrift.session import fresh_path, listing_of
from spindrift.sources import walk
from spindrift.streaming import feed


class Catalogue:
    """Entries with the optional tables that ranking and companions need. Nothing is read before a result is asked for.

    ``words`` and ``name_words`` are vocabularies written before (``content.vocabulary``, ``fuzzy.name_words``);
    without them the texts or names are read when a query needs their words. ``identity`` is the version of the
    listing: cursors hold for it only.
    """

    def __init__(
        self, entries: DataFrame, signals: DataFrame | None = None, picks: DataFrame | None = None,
        features: dict[str, Callable[[str], Column | DataFrame]] | None = None, words: DataFrame | None = None, name_words: DataFrame | None = None,
        identity: str = ""
    ):
        self.entries, self.signals, self.picks, self.features = entries, signals, picks, features or {}
        self.words, self.name_words, self.identity = words, name_words, identity

    def search(
        self, text: str, settings: Settings = Settings(), limit: int = searching.DEFAULT_LIMIT, cursor: str = "", bias: str = "",
        forgive: bool = True, existing: bool = False
    ) -> DataFrame:
        """One page of entries. A first page without any row is searched again with slips forgiven, unless ``forgive`` is off.

        ``existing`` keeps files that are there now; below a folder of this machine (``settings.under``) it always does.
        """
        q = parse(text, settings)
        existing = existing or bool(settings.under and os.path.isdir(settings.under.replace("\\", "/")))
        more = {"bias": bias, "features": self.features, "words": self.words, "existing": existing}
        if cursor:
            last, offset = self._behind(cursor, text, settings)
            return searching.search(self.entries, text, settings, limit, offset, last=last, **more)
        page = searching.search(self.entries, text, settings, limit, **more)
        if q.fuzzy and fuzzy.eligible(q):
            return fuzzy.topped_up(self.entries, page, q, limit).drop("dist")
        known = fuzzy.eligible(q) or fuzzy.rewritable(q) or q.of("content") or (settings.under and existing)
        if not forgive or not known or not page.isEmpty():
            return page
        if settings.under and existing and (listed := self._fallback(settings.under, q)) is not None:
            return searching.search(listed, text, settings, limit, features=self.features)
        if fuzzy.eligible(q):
            return fuzzy.topped_up(self.entries, page, q, limit).drop("dist")
        other = self.respelt(q)
        return searching.search(self.entries, text, settings, limit, query=other, **more) if other else page

    def _fallback(self, folder: str, q: Query) -> DataFrame | None:
        """A bounded listing of a folder of this machine that the entries know nothing of; None where they know it."""
        here = folder.replace("\\", "/")
        low = folder.lower().rstrip("\\")
        if not os.path.isdir(here) or not self.entries.where((F.col("path_l") == low) | F.col("path_l").startswith(low + "\\")).isEmpty():
            return None
        listed, _ = walk.fallback(self.entries.sparkSession, here)
        return listed.select(*[F.col(c) if c in listed.columns else F.lit(None).cast(t).alias(c) for c, t in self.entries.dtypes])

    def respelt(self, q: Query) -> Query | None:
        """The first respelling of a query of several terms, or on texts, that matches; None if there is none."""
        if fuzzy.rewritable(q):
            found = fuzzy.rewritten(self.entries, q, self.name_words)
        else:
            rows = searching.with_content(self.entries, q)
            found = fuzzy.first_match(rows, content.respellings(self.entries, q, self.words), set(rows.columns))
        return found[0] if found else None

    def _behind(self, cursor: str, text: str, settings: Settings) -> tuple[list | None, int]:
        try:
            return None, searching.resume(cursor, text, settings)
        except QueryError:
            return searching.resume_keys(cursor, text, settings, self.identity), 0

    def next_cursor(self, text: str, settings: Settings, offset: int) -> str:
        return searching.cursor(text, settings, offset)

    def cursor_behind(self, page: DataFrame, text: str, settings: Settings, bias: str = "") -> str | None:
        """A token for what comes behind a page, whatever its order; reading on costs no counting of what came before."""
        return searching.key_cursor(page, text, settings, self.identity, bias)

    def results(self, text: str, settings: Settings = Settings(), **more) -> DataFrame:
        return searching.results(self.search(text, settings, **more), parse(text, settings))

    def ranked(
        self, text: str, user: str, settings: Settings = Settings(), limit: int = searching.DEFAULT_LIMIT, current: str = "",
        commits: DataFrame | None = None
    ) -> DataFrame:
        """A page in the order of a person's habits; adds position and place."""
        from pyspark.sql import Window

        q = parse(text, settings)
        page = searching.search(self.entries, text, settings, limit, features=self.features, words=self.words)
        numbered = page.withColumn("position", F.row_number().over(Window.orderBy(*searching.order(q))))
        return ranking.blend(numbered, q, text, user, self.signals, self.picks, current=current, commits=commits)

    def count(self, text: str, settings: Settings = Settings(), forgive: bool = True) -> DataFrame:
        """The number of matches; a query on texts without any is counted as it would be searched, respelt."""
        q = parse(text, settings)
        found = searching.count(self.entries, text, settings, self.features, self.words)
        if forgive and q.of("content") and found.collect()[0]["n"] == 0 and (other := self.respelt(q)):
            return searching.count(self.entries, text, settings, self.features, self.words, other)
        return found

    def lines(self, text: str, settings: Settings = Settings(), before: int = 0, after: int = 0, most: int = 0) -> DataFrame:
        q = parse(text, settings)
        return content.lines(searching.matching(self.entries, q, self.features, self.words), q, before, after, most)

    def content(self, text: str, settings: Settings = Settings(), **more) -> DataFrame:
        """Texts that hold some words: the result rows of the plain words taken as ``content:``."""
        return self.results(contents(text), settings, **more)

    def content_index(self, path: str | None = None) -> Catalogue:
        """A catalogue over a listing written with its vocabularies, to be searched again and again; at ``path``, or in the shared folder."""
        at = path or fresh_path(self.entries.sparkSession, "catalogue")
        parts = {"entries": self.entries, "words": content.vocabulary(self.entries), "name_words": fuzzy.name_words(self.entries)}
        for name, rows in parts.items():
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/{name}")
        return Catalogue.opened_at(self.entries.sparkSession, at, self.signals, self.picks, self.features)

    @classmethod
    def opened_at(
        cls, spark: SparkSession, path: str, signals: DataFrame | None = None, picks: DataFrame | None = None, features: dict | None = None
    ) -> Catalogue:
        """The catalogue that ``content_index`` wrote; its identity is what its files are called."""
        read = {name: spark.read.parquet(f"{path}/{name}") for name in ("entries", "words", "name_words")}
        return cls(read["entries"], signals, picks, features, read["words"], read["name_words"], listing_of(read["entries"]))

    def info(self) -> DataFrame:
        return rollup.statistics(self.entries)

    def recent(self, limit: int = 50) -> DataFrame:
        return ranking.recent(self.signals, limit)

    def opened(self, user: str, path: str, at: int | None = None) -> Catalogue:
        """A catalogue that knows of one more opening."""
        row = self.entries.sparkSession.createDataFrame(
            [(user, path, 1, 1.0, at or int(time.time()))], "user_id string, path string, opens long, score double, last_open_unix long"
        )
        columns = ["user_id", "path", "opens", "score", "last_open_unix"]
        return Catalogue(
            self.entries, row if self.signals is None else self.signals.select(*columns).unionByName(row), self.picks, self.features, self.words,
            self.name_words, self.identity
        )

    def watch(self, since: DataFrame) -> DataFrame:
        """Events that lead from an earlier state of the entries to this one."""
        return feed.watch(since, self.entries)

    def bench(self, queries: list[str], settings: Settings = Settings(), rounds: int = 3) -> DataFrame:
        """Seconds of each query: query, seconds; ``rollup.latencies`` sums them up."""
        took = []
        for text in queries:
            for _ in range(rounds):
                began = time.perf_counter()
                self.search(text, settings).write.format("noop").mode("overwrite").save()
                took.append((text, time.perf_counter() - began))
        return self.entries.sparkSession.createDataFrame(took, "query string, seconds double")


SYNTAX = f"""word            in the name, without regard to case and marks        "two words"     as they stand
'name ^pre suf$ whole name, beginning, end                            a|b  !a  -a     either, not
path:t  a/b     in the path                                           dir:t parent:d  in the path, name of the folder
in:folder       below a folder                                        ext:x type:file|dir
*.{{c,h}} glob:p  pattern for names; with / or ** for paths             regex:re        pattern for paths
size:>1mb       > >= < <= =, k m g t                                  dm:today 7d 2026-01-31 thisweek
attrib:RHSDA    all of these                                          git:modified,staged,untracked,ignored,conflict,clean,tracked
content:w       in the text; "a phrase", /a pattern/                  content~1:w     a word within so many slips
sym:name        a line that defines it                                feature:name:t  what a companion finds
case:           with case from here on                                sort:{'|'.join(SORTS)}
near:path       nearer first                                          word~           with slips"""
