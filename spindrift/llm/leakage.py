"""Evaluation texts in training texts: whole sentences, or runs of more than half of an item, verbatim or lightly altered.

Texts and items are reduced to lower-case words. From every word of every item's sentence a string is taken, and all
of them are searched in all texts at once (``wu_manber``, a table per length of string: long sentences have long ones,
sentences too short for any are searched whole). Each hit is confirmed by direct comparison: byte by byte where the
sentence stands there as it is, else word by word, with altered words as gaps. A sentence that many different texts
share is stock and proves nothing by itself.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.folding import marks, plain, words_only
from spindrift.llm.wu_manber import Patterns
from spindrift.session import written

#: Share of a sentence's words that must be found; share of an item's words that a run must exceed; words of the run that must agree.
SENTENCE, RUN, AGREE = 0.7, 0.5, 0.75
#: A sentence is stock if more than this share of the different texts hold it, and more than this many.
STOCK_SHARE, STOCK_LEAST = 0.01, 10
#: Words between two pieces of one run. A run has at most ``STRETCH`` times the words of its item.
GAP, STRETCH = 3, 2
#: Share of a sentence's bytes, or of half of an item's, that must stand unaltered in stretches of a string's length before words are compared.
COVER = 1 / 3
#: Bytes of sentences that are searched at a time (their tables take some 40 times as much in a task).
BLOCK_BYTES = 4 << 20
#: Bytes from which a sentence is found by strings of so many bytes; below the last it is searched whole, by its first bytes.
LONG = ((60, 20), (18, 12))
WHOLE = (12, 6, 3)
#: Characters that are words by themselves.
_SINGLE = re.compile(r"[぀-ヿ㐀-鿿]")
_TOKEN = re.compile(rf"{_SINGLE.pattern}|[^ \n぀-ヿ㐀-鿿]+")


def _tokens(text: str) -> list[str]:
    return _TOKEN.findall(text) if _SINGLE.search(text) else text.split()


def _alike(a: str, b: str) -> bool:
    """Whether two words differ by a slip of the keys: letters changed places, or one is missing, added or wrong."""
    if a == b or (len(a) == len(b) and sorted(a) == sorted(b)):
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def _blocks(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Matching stretches (position in a, in b, length), with slips between two stretches taken as matches."""
    found = [tuple(m) for m in SequenceMatcher(None, a, b, False).get_matching_blocks() if m.size]
    out: list[tuple[int, int, int]] = []
    for i, j, n in found:
        if out:
            x, y, k = out[-1]
            gap = i - x - k
            if 0 < gap == j - y - k and gap <= GAP:
                out += [(x + k + d, y + k + d, 1) for d in range(gap) if _alike(a[x + k + d], b[y + k + d])]
        out.append((i, j, n))
    return out


def _run(blocks: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """Span in words, agreeing words and first word of the longest run of stretches with short gaps only."""
    best = (0, 0, 0)
    start = matched = 0
    for at, (i, j, n) in enumerate(blocks):
        if not at or i - sum(blocks[at - 1][::2]) > GAP or j - blocks[at - 1][1] - blocks[at - 1][2] > GAP:
            start, matched = i, 0
        matched += n
        best = max(best, (i + n - start, matched, start))
    return best


def _covered(at: list[tuple[int, int]]) -> int:
    """Bytes of a text that lie in hits (position, length), in order of position."""
    return sum(min(n, q - p) for (p, n), (q, _) in zip(at, at[1:])) + at[-1][1] if at else 0


def _back(text: bytes, at: int, words: int) -> int:
    """Where the word begins that stands so many words before a position."""
    step = 8 * words + 8
    while step < at and text.count(b" ", at - step, at) <= words:
        step *= 2
    piece = text[max(0, at - step) : at]
    kept = piece.rsplit(b" ", words + 1)
    return at - (len(piece) - len(kept[0]) if len(kept) > words + 1 else len(piece))


def _ahead(text: bytes, at: int, words: int) -> int:
    """Where the word ends that stands so many words behind a position."""
    step = 8 * words + 8
    while at + step < len(text) and text.count(b" ", at, at + step) <= words:
        step *= 2
    piece = text[at : at + step]
    kept = piece.split(b" ", words + 1)
    return at + (len(piece) - len(kept[-1]) if len(kept) > words + 1 else len(piece))


class Items:
    """The patterns of a block of items: sentences, their words, and which items hold them.

    Sentences are kept with a space on either side. An item with sentences that are searched whole only is searched
    by strings across its sentences as well, so that runs are found; such a text of all its words has a number behind
    those of the sentences.
    """

    def __init__(self, items: list[tuple[int, list[str]]]):
        numbers: dict[str, int] = {}
        self.item_ids, self.item_words, self.item_sentences, self.word_sentences = [], [], [], []
        for item, sentences in items:
            own = [numbers.setdefault(s, len(numbers)) for s in sentences if s]
            self.item_ids.append(item)
            self.item_sentences.append(own)
            words = [_tokens(s) for s in sentences if s]
            self.item_words.append([w for x in words for w in x])
            self.word_sentences.append([n for n, x in zip(own, words) for _ in x])
        texts = list(numbers)
        self.sentences = len(texts)
        self.keys = [int.from_bytes(blake2b(s.encode(), digest_size=8).digest(), "little", signed=True) for s in texts]
        self.holders: dict[int, list[int]] = defaultdict(list)
        for i, own in enumerate(self.item_sentences):
            for s in dict.fromkeys(own):
                self.holders[s].append(i)
        self.brief = [len(s.encode()) < LONG[-1][0] for s in texts]
        for i, own in enumerate(self.item_sentences):
            if any(self.brief[s] for s in own) and len(whole := " ".join(texts[s] for s in own)) >= LONG[-1][0]:
                self.holders[len(texts)].append(i)
                self.brief.append(False)
                texts.append(whole)
        self.words = [_tokens(s) for s in texts]
        self.raw = [f" {s} ".encode() for s in texts]
        self.item_bytes = [sum(len(self.raw[s]) - 1 for s in own) for own in self.item_sentences]
        self.size = [0] * len(texts)
        strings: dict[int, list[bytes]] = defaultdict(list)
        owner: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for s, raw in enumerate(self.raw):
            if self.brief[s]:
                size = self.size[s] = next(n for n in WHOLE if n <= len(raw))
                strings[size].append(raw[:size])
                owner[size].append((s, 0, 0))
                continue
            size = self.size[s] = next(n for least, n in LONG if len(raw) - 2 >= least)
            for k, m in enumerate(_TOKEN.finditer(texts[s])):
                at = m.start() + 1 if texts[s].isascii() else len(texts[s][: m.start()].encode()) + 1
                if at + size <= len(raw):
                    strings[size].append(raw[at : at + size])
                    owner[size].append((s, at, k))
        self.patterns = [(Patterns(x, size), np.array(owner[size], np.int64)) for size, x in strings.items()]

    def hits(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All hits in some texts: positions, and rows of (sentence, offset in it, word of it)."""
        found = [(pos, owner[number]) for table, owner in self.patterns for pos, number in [table.search(data, starts, lengths)]]
        return np.concatenate([np.zeros(0, np.int64), *[p for p, _ in found]]), np.concatenate([np.zeros((0, 3), np.int64), *[o for _, o in found]])

    def search(self, lined: bytes, text: bytes, hits: dict[int, list[tuple[int, int, int]]]) -> tuple[set[int], dict[int, int]]:
        """Sentences and items (numbers) that a text holds, from the hits (position, offset, word) of each sentence.

        ``lined`` is the text with its sentences on lines of their own, ``text`` the same with spaces only. For an
        item, the one sentence that the run found doesn't reach beyond, -1 if it does.
        """
        whole: set[int] = set()
        by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)  # hits (position, length)
        for s, at in hits.items():
            if s < self.sentences:
                raw, brief = self.raw[s], self.brief[s]
                for p, o, _ in at:
                    b, e = p - o, p - o + len(raw)
                    # few words may meet anywhere; as a sentence they stand alone
                    if b >= 0 and text[b:e] == raw and not (brief and (lined[b] != 10 or lined[e - 1] != 10)):
                        whole.add(s)
                        break
                if not brief and s not in whole and self._altered(text, s, at):
                    whole.add(s)
            if not self.brief[s]:
                for i in self.holders[s]:
                    by_item[i] += [(p, self.size[s]) for p, *_ in at]
        # whatever stands whole may turn out to be stock, so runs are looked for in any case
        runs = {i: within for i, at in by_item.items() if (within := self._within(text, i, sorted(at))) is not None}
        return whole, runs

    def _within(self, text: bytes, i: int, at: list[tuple[int, int]]) -> int | None:
        """The one sentence that a run of more than half of an item doesn't reach beyond, -1 if it does; None without such a run.

        A run is no longer than ``STRETCH`` items, so the words around a hit hold any run whose first hit is within
        as many words behind it.
        """
        size, found, k = len(self.item_words[i]), None, 0
        reach, least = STRETCH * size, COVER * RUN * self.item_bytes[i]
        if _covered(at) < least:
            return None
        while k < len(at):
            first = at[k][0]
            last = _ahead(text, first, reach)
            end = _ahead(text, last, reach)
            near = at[k : bisect_right(at, (end, 0))]
            k = bisect_right(at, (last, 99), k)
            if _covered(near) < least:
                continue
            blocks = _blocks(self.item_words[i], _tokens(text[_back(text, first, reach) : end].decode("utf-8", "ignore")))
            span, agree, begin = _run(blocks)
            if span > RUN * size and agree >= AGREE * span:
                (most, count), *_ = (
                    Counter(self.word_sentences[i][x] for a, _, n in blocks for x in range(a, a + n) if begin <= x < begin + span).most_common(1)
                )
                if agree - count > GAP:
                    return -1
                found = most
        return found

    def _altered(self, text: bytes, s: int, hits: list[tuple[int, int, int]]) -> bool:
        """Whether enough words of a sentence stand around its hits, with at most half as many words put in."""
        words, size = self.words[s], len(self.raw[s])
        half = len(words) // 2 + 2
        # the sentence may stand in the text more than once: each cluster of hits is looked at by itself
        ordered = sorted(hits, key=lambda h: h[0] - h[1])
        cluster: list[tuple[int, int, int]] = []
        for h in [*ordered, None]:
            if h is not None and (not cluster or h[0] - h[1] - cluster[-1][0] + cluster[-1][1] < size // 4 + 8):
                cluster.append(h)
                continue
            first, last = min(cluster), max(cluster)
            if _covered([(p, self.size[s]) for p, *_ in sorted(cluster)]) < COVER * size:
                cluster = [h] if h is not None else []
                continue
            part = _tokens(
                text[_back(text, first[0], first[2] + half) : _ahead(text, last[0], len(words) - last[2] + half)].decode("utf-8", "ignore")
            )
            if sum(n for _, _, n in _blocks(words, part)) >= SENTENCE * len(words):
                return True
            cluster = [h] if h is not None else []
        return False


def sentence_lines(text: Column) -> Column:
    """``words_only`` with sentences on lines of their own and a line feed at either end.

    A line feed stands for whatever has a line's end, a bracket, a double quote, or a stop that no letter follows.
    """
    old, new = marks()
    apart = "…\"“”„«»()[]。！？「」『』"
    marked = F.translate(F.lower(F.regexp_replace(text, r"\p{M}+", "")), old + apart, new + "\n" * len(apart))
    few = "".join(c for c in apart if c.isascii())
    bare = F.when(plain(text), F.translate(F.lower(text), few, "\n" * len(few))).otherwise(marked)
    words = F.regexp_replace(F.regexp_replace(bare, r"[.!?:;](?![\p{L}\p{N}])", "\n"), r"[^\p{L}\p{N}\n]+", " ")
    return F.concat(F.lit("\n"), F.trim(F.regexp_replace(words, r" ?\n[ \n]*+", "\n"), F.lit(" \n")), F.lit("\n"))


def _sentences(items: DataFrame, key: str, column: str) -> DataFrame:
    parts = items.where(F.col(key).isNotNull()).select(key, F.posexplode(F.split(column, r"(?<=[.!?])\s+|(?<=[。！？])|\n")).alias("_i", "_s"))
    return parts.select(key, "_i", words_only(F.col("_s")).alias("_s")).where("_s <> ''")


def _item_blocks(items: DataFrame) -> Iterator[Items]:
    """Items in blocks of ``BLOCK_BYTES``; partitions of the sorted items pass through the driver one at a time."""
    rows = _sentences(items, "item_id", "text").distinct().orderBy("item_id", "_i").toLocalIterator()
    held: list[tuple[int, list[str]]] = []
    size = 0
    for item, own in groupby(rows, key=lambda r: r["item_id"]):
        held.append((item, [r["_s"] for r in own]))
        size += sum(len(s.encode()) for s in held[-1][1])
        if size >= BLOCK_BYTES:
            yield Items(held)
            held, size = [], 0
    if held:
        yield Items(held)


def _found(texts: DataFrame, items: Items) -> DataFrame:
    """(doc, text, sentence, item): sentences that stand in a text have no item, runs of items the one sentence they lie in or none; every text has a row with neither.

    ``text`` is the same for equal texts, ``sentence`` for equal sentences of any block.
    """
    # pickled by value, so executors need no copy of this package
    sent = texts.sparkSession.sparkContext.broadcast(cloudpickle.dumps(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            held = column.buffers()[2]
            lined = np.concatenate([np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8), np.zeros(16, np.uint8)])
            data = np.where(lined == 10, np.uint8(32), lined)
            pos, owner = own.hits(data, offsets[:-1], np.diff(offsets))
            row = np.searchsorted(offsets, pos, "right") - 1
            order = np.argsort(row, kind="stable")
            ids, same = (batch.column(i).to_pylist() for i in (0, 2))
            out: list[tuple[int, int, int | None, int | None]] = [(d, t, None, None) for d, t in zip(ids, same)]
            edge = np.flatnonzero(np.diff(row[order], prepend=-1)) if len(order) else []
            for a, b in zip(edge, [*edge[1:], len(order)]):
                r, part = int(row[order[a]]), order[a:b]
                hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
                begin, end = int(offsets[r]), int(offsets[r + 1])
                for p, (s, o, k) in zip((pos[part] - begin).tolist(), owner[part].tolist()):
                    hits[s].append((p, o, k))
                whole, runs = own.search(lined[begin:end].tobytes(), data[begin:end].tobytes(), hits)
                out += [(ids[r], same[r], own.keys[s], None) for s in whole] + [
                    (ids[r], same[r], own.keys[s] if s >= 0 else None, own.item_ids[i]) for i, s in runs.items()
                ]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], ["doc", "text", "sentence", "item"])

    return texts.mapInArrow(run, "doc long, text long, sentence long, item long")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs of item and document that leaked: item_id, doc_id.

    ``documents``: doc_id, text; ``items``: item_id, text. Null and empty texts match nothing; sentences of less than
    18 bytes count whole only where they stand as a sentence of the text; repeated rows give each pair once. Stock is
    judged by different texts, so copies of one text count once, however many items hold a sentence; a run that
    reaches beyond one sentence leaked whatever is stock in it. Items are searched in blocks, each of a bounded size,
    so the tables sent to the tasks don't grow with the items; with more than one block, texts are folded once and kept.
    """
    spark = documents.sparkSession
    blocks = _item_blocks(items)
    block, found, holders = next(blocks, None), [], []
    while block is not None:
        following = next(blocks, None)
        if not found:
            # where sentences end matters to sentences that are searched whole only
            lined = following is not None or any(block.brief)
            words = sentence_lines(F.col("text")) if lined else F.concat(F.lit("\n"), words_only(F.col("text")), F.lit("\n"))
            texts = documents.where("doc_id is not null and text is not null").select("doc_id", words.alias("t"))
            texts = texts.withColumn("text", F.xxhash64(F.translate("t", "\n", " ")))
            if following is not None:
                texts, _ = written(texts, "folded")
        found.append(written(_found(texts, block), "leaks")[0])
        holders.append(
            spark.createDataFrame(
                [(block.keys[s], block.item_ids[i]) for s in range(block.sentences) for i in block.holders[s]], "sentence long, item_id long"
            )
        )
        block = following
    if not found:
        return spark.createDataFrame([], "item_id long, doc_id long")
    limit = max(STOCK_LEAST, STOCK_SHARE * found[0].select("text").distinct().count())
    every, holding = reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, holders)
    held = every.where("sentence is not null and item is null").select("doc", "text", "sentence").distinct()
    stock = held.select("text", "sentence").distinct().groupBy("sentence").count().where(F.col("count") > limit).select("sentence")
    runs = every.where("item is not null").join(stock, "sentence", "left_anti").select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"))
    return (
        held.join(stock, "sentence", "left_anti")
            .join(holding, "sentence")
            .select("item_id", F.col("doc").alias("doc_id"))
            .unionByName(runs)
            .distinct()
    )
