"""Text that went through a wrong character encoding: found, and restored where that is possible.

A hidden Markov model labels every character. One state is clean; each other state stands for a pair of encodings, the
true one and the one the bytes were wrongly read in. The clean state emits characters by a bigram model of the
collection; a pair's state emits what its *inverse transform* gives, by the same bigram model - so a span belongs to a
pair if the text reads better once the pair is undone. Staying is free, entering and leaving a state costs. The most
probable path (Viterbi, over all texts of a batch at once) gives the spans; each span gets its state's inverse
transform, and the outcome is labelled again, for text that was garbled more than once.

The bigram model is trained on the collection itself: first on all texts, then again without those found garbled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.session import written

#: Characters that the model tells apart, by frequency; the others seen share a class per block of so many code points.
ALPHABET, SPAN = 2000, 256
ENTER, LEAVE, INVALID, FLOOR = -9.0, -1.0, -14.0, 1e-8
#: Entering a state that reads UTF-8 costs less: its lead and continuation bytes seldom meet by chance.
ENTER_UNIT = -2.0
#: Entering a mapped state right behind a character that it would have changed as well: words are garbled whole.
ENTER_LATE = -3.0
#: Share of the collection by which bigrams are smoothed; log probability of one character of blocks never seen, given that it is such a one.
SMOOTH, RARE = 2e-4, -8.0
#: Bytes of the table (as stored) that a task labels, about.
PART = 4 << 20
#: Characters labelled at once, about.
BATCH = 1 << 18

#: Names of encodings. Single-byte ones by what they write, and those in which bytes get misread.
WESTERN = ["cp1252", "mac_roman", "cp850", "cp437"]
CENTRAL = ["cp1250", "iso8859_2", "cp852"]
CYRILLIC = ["cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic"]
GREEK = ["cp1253", "iso8859_7", "cp737"]
READ_AS = [
    "cp1252", "mac_roman", "cp850", "cp437", "cp1251", "koi8_r", "cp866", "cp1250", "cp852", "cp1253", "iso8859_2", "iso8859_5", "iso8859_7",
    "latin_1"
]
JAPANESE = ["cp932", "euc_jp"]


def _char(byte: int, encoding: str) -> str | None:
    """The character of a byte; bytes that cp125x leaves free pass as control characters, as common decoders have it."""
    try:
        return bytes([byte]).decode(encoding)
    except UnicodeDecodeError:
        return chr(byte) if encoding.startswith("cp125") else None


def _pairs() -> list[tuple[str, str, str]]:
    """(kind, read as, true): ``bytes`` decode as UTF-8 (``utf_8*utf_8``: twice), ``table`` maps character by character."""
    out = [("bytes", w, "utf_8") for w in READ_AS]
    twice = [("bytes", "cp1252", "*".join(["utf_8"] * n)) for n in (2, 3)]
    for true, wrong in (
        (WESTERN, READ_AS), (CENTRAL, ["cp1252", "mac_roman", "cp850", "cp437", "cp1251", "koi8_r", "cp866", "cp1250", "cp852", "iso8859_2"]),
        (CYRILLIC, ["cp1252", "mac_roman", "cp850", "cp437", "cp1251", "koi8_r", "cp866", "mac_cyrillic"]),
        (GREEK, ["cp1252", "mac_roman", "cp850", "cp437", "cp1251", "koi8_r", "cp866"])
    ):
        out += [("table", w, t) for t in true for w in wrong if w != t]
    # two single-byte encodings can agree on what matters; the first of equal tables stays
    seen, kept = set(), []
    for kind, w, t in out:
        key = (kind, *[(_char(b, w), _char(b, t) if kind == "table" else b) for b in range(128, 256)])
        if key not in seen:
            seen.add(key)
            kept.append((kind, w, t))
    kept += twice
    kept += [("multi", w, t) for t in JAPANESE for w in ("cp1252", "mac_roman", "cp437", "cp866", "cp1251", "latin_1")]
    return [*kept, ("swap", "utf_16_be", "utf_16_le"), ("wide", "utf_16_le", "utf_8"), ("wide", "utf_16_be", "utf_8"), ("lost", "utf_8", "unknown")]


class Model:
    """Log probabilities of bigrams over an alphabet of the collection: its frequent characters, then the classes of its
    other characters (one a block of code points). Row and column 0 stand for characters of blocks never seen.

    The weight of the single characters grows with the collection: else a few garbled texts, whose bigrams follow each
    other as regularly as those of the text they came from, would look as likely as that.
    """

    def __init__(self, alphabet: Alphabet, bigrams: np.ndarray):
        self.alphabet = alphabet
        n = alphabet.size
        single = bigrams.sum(0) + 0.01
        single = np.maximum(single / single.sum(), FLOOR)
        rows = bigrams.sum(1, keepdims=True)
        weight = 4.0 + SMOOTH * bigrams.sum()
        self.log = np.log((bigrams + weight * single) / (rows + weight)).astype(np.float32)
        self.log += alphabet.share.astype(np.float32)  # of one character in its class
        self.single = (np.log(single) + alphabet.share).astype(np.float32)
        self.single[0] = np.log(single[0])
        self.best = self.log.max(0)
        assert self.log.shape == (n, n)

    def ids(self, points: np.ndarray) -> np.ndarray:
        return self.alphabet.ids(points)


class Alphabet:
    """Numbers of characters: 1.. for frequent ones, then for the blocks of the others, 0 for what was never seen."""

    def __init__(self, chars: np.ndarray, blocks: np.ndarray, members: np.ndarray):
        self.chars, self.blocks = chars, blocks
        self.size = 1 + len(chars) + len(blocks)
        self.share = np.r_[RARE, np.zeros(len(chars)), -np.log(np.maximum(members, 1))]

    @staticmethod
    def _at(known: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Places in a sorted list from 1, 0 for what isn't in it."""
        if not len(known):
            return np.zeros(len(values), np.int64)
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return np.where(known[at] == values, at + 1, 0)

    def ids(self, points: np.ndarray) -> np.ndarray:
        found = self._at(self.chars, points)
        rest = np.flatnonzero(found == 0)
        if len(rest) and len(self.blocks):
            block = self._at(self.blocks, points[rest] // SPAN)
            found[rest] = np.where(block > 0, len(self.chars) + block, 0)
        return found


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _units(points: np.ndarray, byte: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What bytes say as UTF-8, at every position of a unit, and which positions continue one; -1 where they say nothing."""
    n = len(points)
    out = np.where((points >= 0) & (points < 128), points, -1)
    more = np.zeros(n, bool)
    cont = (byte >= 0x80) & (byte < 0xC0) & ~first
    after = [np.r_[cont[i:], np.zeros(min(i, n), bool)] for i in (1, 2, 3)]
    val = [np.r_[byte[i:], np.zeros(min(i, n), np.int64)] & 0x3F for i in (1, 2, 3)]
    for low, high, size, mask in ((0xC2, 0xDF, 2, 0x1F), (0xE0, 0xEF, 3, 0x0F), (0xF0, 0xF4, 4, 0x07)):
        ok = (byte >= low) & (byte <= high)
        for i in range(size - 1):
            ok = ok & after[i]
        at = np.flatnonzero(ok)
        point = byte[at] & mask
        for i in range(size - 1):
            point = (point << 6) | val[i][at]
        good = (point >= {2: 0x80, 3: 0x800, 4: 0x10000}[size]) & (point < 0x110000) & ~((point >= 0xD800) & (point < 0xE000))
        at, point = at[good], point[good]
        for i in range(size):
            out[at + i] = point
            if i:
                more[at + i] = True
    return out, more


class Labeller:
    """Viterbi over batches of texts."""

    def __init__(self, model: Model):
        self.model, self.pairs = model, _pairs()
        self.late = np.array([ENTER_LATE if kind == "table" else 0.0 for kind, *_ in self.pairs], np.float32)
        self.enter = np.array([ENTER_UNIT if kind == "bytes" else ENTER for kind, *_ in self.pairs], np.float32)
        # pairs of ASCII characters that are likelier with their bytes swapped
        plain, turned = model.ids(np.arange(128)), model.ids(np.arange(128) << 8)
        self.turned = model.log[turned[:, None], turned] > model.log[plain[:, None], plain]
        self.tables = []
        for kind, w, t in self.pairs:
            table: dict[int, int] = {}
            if kind in {"table", "bytes", "multi"}:
                for b in range(128, 256):
                    c, u = _char(b, w), (_char(b, t) if kind == "table" else chr(b))
                    if c is not None and u is not None and len(c) == 1 and ord(c) > 127:
                        table.setdefault(ord(c), ord(u))
                if w == "cp1252" and kind != "table":
                    for b in range(128, 160):  # latin-1 and cp1252 get mixed in practice
                        table.setdefault(b, b)
            self.tables.append(table)

    def _decoded(
        self, k: int, points: np.ndarray, uniq: np.ndarray, code: np.ndarray, first: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Per position: the code point that the state reads there (-1: none), whether it continues a unit, and a second point."""
        kind = self.pairs[k][0]
        ascii_ = points < 128
        none = np.zeros(len(points), bool)
        if kind == "table":
            own = np.array([u if u < 128 else self.tables[k].get(u, -1) for u in uniq.tolist()], np.int64)
            return own[code], none, None
        if kind == "lost":
            return np.where(ascii_, points, -1), none, None
        if kind == "swap":
            turned = ((points & 0xFF) << 8) | (points >> 8)  # ASCII as well: U+4E00 looks like N
            ok = (points > 0) & (points < 0x10000) & ((turned < 0xD800) | (turned > 0xDFFF))
            return np.where(ok, turned, -1), none, None
        if kind == "wide":
            return self._wide(k, points, first)
        own = np.array([self.tables[k].get(u, -1) for u in uniq.tolist()], np.int64)
        if kind == "multi":
            return self._multi(k, points, own[code], np.where(ascii_, points, -1), none.copy(), first)
        out, more = _units(points, own[code], first)
        for _ in range(self.pairs[k][2].count("*")):
            at = np.flatnonzero(~more)
            inner = out[at]
            there, back = np.unique(inner, return_inverse=True)
            byte = np.array([self.tables[k].get(u, -1) for u in there.tolist()], np.int64)[back]
            deep, more2 = _units(inner, byte, first[at])
            # what only this layer can't undo isn't in this state
            more = more.copy()
            more[at] = more2
            out = out.copy()
            out[at] = deep
            where = np.maximum.accumulate(np.where(more, 0, np.arange(len(out))))
            out = out[where]
        return out, more, None

    def _wide(self, k: int, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 read two bytes at a time: the characters that begin in each position, up to two; units may cross positions."""
        a, b = (points & 0xFF, points >> 8) if self.pairs[k][1] == "utf_16_le" else (points >> 8, points & 0xFF)
        ascii_, fits = points < 128, points < 0x10000
        byte, begin = np.empty(2 * len(points), np.int64), np.zeros(2 * len(points), bool)
        byte[::2], byte[1::2], begin[::2] = np.where(ascii_, points, np.where(fits, a, -1)), np.where(ascii_ | ~fits, -1, b), first
        out, more = _units(byte, byte, begin)
        control = (out >= 0) & (out < 32) & ~np.isin(out, (9, 10, 13))
        out[control & ~np.repeat(ascii_, 2)] = -1
        one, two, goes_on, ends = out[::2], out[1::2], more[::2], more[1::2]
        valid = ascii_ | ((one >= 0) & (two >= 0))
        read = np.where(valid, np.where(goes_on & ~ends, two, one), -1)
        return read, valid & goes_on & ends, np.where(valid & ~ascii_ & ~goes_on & ~ends, two, -1)

    def _multi(
        self, k: int, points: np.ndarray, byte: np.ndarray, out: np.ndarray, more: np.ndarray, first: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, None]:
        """Double-byte text: runs that hold two high bytes at least are decoded one after the other."""
        true, n = self.pairs[k][2], len(points)
        high = np.where(points < 128, points, byte)
        lead = ((byte >= 0x81) & (byte <= 0x9F)) | ((byte >= 0xE0) & (byte <= 0xFC)) if true == "cp932" else (byte >= 0xA1) & (byte <= 0xFE)
        i, at = 0, np.flatnonzero(lead)
        for p in at.tolist():
            if p < i or p + 1 >= n or first[p + 1] or high[p + 1] < 0x40:
                continue
            try:
                c = bytes([int(byte[p]), int(high[p + 1])]).decode(true)
            except (UnicodeDecodeError, ValueError):
                continue
            if len(c) == 1:
                out[p] = out[p + 1] = ord(c)
                more[p + 1] = True
                i = p + 2
        return out, more, None

    def suspects(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which texts hold two characters that are likelier one, misread as UTF-8; and for each text and pair, whether
        a path through the pair's state could win, by an upper bound of what it gains. Texts without a pair are clean.

        A mapped pair gains at a bigram what its reading of it is likelier than the text as it stands, so the sum of its
        positive gains over the text bounds every span of it; a double-byte unit is read at most as likely as behind
        the best character before it. For UTF-8 read as UTF-16 the text is read as a whole. UTF-8 needs a whole unit.
        """
        lens = np.array([len(t) for t in texts], np.int64)
        points = _points("".join(texts))
        start = np.cumsum(lens) - lens
        wins, units = np.zeros((len(texts), len(self.pairs)), bool), np.zeros(len(texts), bool)
        if not len(points):
            return units, wins
        text = np.repeat(np.arange(len(texts)), lens)
        before = np.r_[32, points[:-1]]
        before[start[lens > 0]] = 32
        odd = (points > 127) | (before > 127)
        at = np.flatnonzero(odd | self.turned[np.minimum(before, 127), np.minimum(points, 127)])
        if not len(at):
            return units, wins
        pair, back = np.unique((before[at] << 21) | points[at], return_inverse=True)
        p, c = pair >> 21, pair & 0x1FFFFF
        uniq, code = np.unique(np.r_[p, c], return_inverse=True)
        cp, cc = code[: len(p)], code[len(p) :]
        own, where = self.model.ids(uniq), text[at]
        clean = self.model.log[own[cp], own[cc]]
        stands = clean[back]  # of each place; for two places, of both
        both = stands + np.where(np.r_[False, at[1:] == at[:-1] + 1], np.r_[0, stands[:-1]], 0)
        need = -(ENTER + LEAVE)
        likely, whole = np.zeros(len(pair), bool), np.ones(len(uniq), bool)
        gains = lambda g: np.bincount(where, g, len(texts)) >= need
        for k, (kind, w, true) in enumerate(self.pairs):
            if kind == "wide":
                wins[:, k] = self._wide_gains(k, points, lens) >= need
            elif kind in {"table", "swap"}:
                read, _, _ = self._decoded(k, uniq, uniq, np.arange(len(uniq)), whole)
                ids = self.model.ids(read)
                win = np.maximum(np.where(read[cc] < 0, INVALID, self.model.log[ids[cp], ids[cc]]) - clean, 0)
                if win.any():
                    wins[:, k] = gains(win[back])
            elif kind == "bytes" and "*" not in true:
                byte = np.array([self.tables[k].get(u, -1) for u in uniq.tolist()], np.int64)
                unit = (byte[cp] >= 0xC2) & (byte[cp] <= 0xF4) & (byte[cc] >= 0x80) & (byte[cc] < 0xC0)
                held = where[unit[back]]
                for i, x in enumerate(self.pairs):
                    if x[0] == "bytes" and x[1] == w:
                        wins[held, i] = True
                read = np.where(unit & (byte[cp] < 0xE0), ((byte[cp] & 0x1F) << 6) | (byte[cc] & 0x3F), 0)
                likely |= (read > 0) & (self.model.single[self.model.ids(read)] > self.model.single[own[cp]] + clean)
            elif kind == "multi":
                byte = np.array([u if u < 128 else self.tables[k].get(u, -1) for u in uniq.tolist()], np.int64)
                read, more, _ = self._multi(
                    k, np.stack([p, c], 1).ravel(), np.stack([np.where(p < 128, -1, byte[cp]), np.where(c < 128, -1, byte[cc])], 1).ravel(),
                    np.full(2 * len(p), -1), np.zeros(2 * len(p), bool), np.tile([True, False], len(p))
                )
                unit = more[1::2] & (read[::2] >= 0)
                if unit.any():
                    best = np.where(unit, self.model.best[self.model.ids(np.maximum(read[::2], 0))], 0)
                    wins[:, k] = gains(np.where(unit[back], np.maximum(best[back] - both, 0), 0))
            elif kind == "lost":
                wins[text[points == 0xFFFD], k] = True
        units[where[likely[back]]] = True
        return units, wins

    def _wide_gains(self, k: int, points: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """What a span of UTF-8 read as UTF-16 gains at most in each text."""
        text, model = np.repeat(np.arange(len(lens)), lens), self.model
        low, high = points & 0xFF, points >> 8
        fit = lambda x: (x >= 32) | (x == 9) | (x == 10) | (x == 13)
        some = np.zeros(len(lens), bool)
        some[text[(points < 0x10000) & (points > 127) & fit(low) & fit(high)]] = True
        here = some[text]
        gains, points, text = np.zeros(len(lens)), points[here], text[here]
        if not len(points):
            return gains
        first = np.r_[True, text[1:] != text[:-1]]
        read, more, second = self._wide(k, points, first)
        own, ids = model.ids(points), model.ids(read)
        last = np.where(second >= 0, model.ids(np.maximum(second, 0)), ids)
        space = model.ids(np.array([32]))[0]
        was, last_was = (np.where(first, space, np.r_[space, x[:-1]]) for x in (own, last))
        e = model.log[last_was, ids] + np.where(second >= 0, model.log[ids, last], 0)
        e = np.where(more, 0, np.where(read < 0, INVALID, e))
        return np.bincount(text, np.maximum(e - model.log[was, own], 0), len(lens))

    def label(self, texts: list[str], wins: np.ndarray | None = None) -> list[np.ndarray]:
        """The state of every character: 0 clean, k + 1 the k-th pair. ``wins``: what ``suspects`` says of these texts.

        Each text has the clean state and one for each pair that could win in it, so texts differ in what their states
        stand for; those with as many are labelled together best.
        """
        wins = self.suspects(texts)[1] if wins is None else wins
        order = np.argsort([-len(t) for t in texts], kind="stable")
        wins, lens = wins[order], np.array([len(texts[i]) for i in order], np.int64)
        points = _points("".join(texts[i] for i in order))
        start, total = np.cumsum(lens) - lens, len(points)
        if not total or not wins.any():
            return [np.zeros(len(t), np.uint8) for t in texts]
        states = int(wins.sum(1).max())
        place = np.cumsum(wins, 1) - 1  # the state of a pair in a text
        pair_of = np.zeros((len(texts), states), np.int64)
        row, pair = np.nonzero(wins)
        pair_of[row, place[row, pair]] = pair
        used = np.arange(states) < wins.sum(1)[:, None]
        first = np.zeros(total, bool)
        first[start[lens > 0]] = True
        emit, closed = self._emissions(points, first, start, lens, wins, place, states)
        enter_cost = np.where(used, self.enter[pair_of], np.float32(-1e30))
        late_cost = self.late[pair_of]
        best = np.full((len(texts), states + 1), -1e30, np.float32)
        best[:, 0] = 0
        longest = int(lens[0])
        came = np.zeros((total, states + 1), np.uint8)  # for clean: the state before; for a pair: 1 if it was entered here
        high = points > 127
        for t in range(longest):
            live = int(np.searchsorted(-lens, -t, side="left"))  # texts longer than t
            at = start[:live] + t
            now = best[:live]
            out = now[:, 1:].argmax(1)
            leave = now[np.arange(live), out + 1] + LEAVE
            clean = np.maximum(now[:, 0], leave)
            enter = now[:, :1] + enter_cost[:live]
            if t:
                enter += high[at - 1, None] * late_cost[:live]
            enter = np.where(closed[at], np.float32(-1e30), enter)
            came[at, 0] = np.where(leave > now[:, 0], out + 1, 0)
            came[at, 1:] = enter > now[:, 1:]
            step = emit[at]
            best[:live, 1:] = np.maximum(now[:, 1:], enter) + step[:, 1:]
            best[:live, 0] = clean + step[:, 0]
        best[:, 1:] += LEAVE
        state = best.argmax(1)
        labels = np.zeros(total, np.uint8)
        number = np.c_[np.zeros(len(texts), np.int64), pair_of + 1]
        for t in range(longest - 1, -1, -1):
            live = int(np.searchsorted(-lens, -t, side="left"))
            at, s = start[:live] + t, state[:live]
            labels[at] = number[np.arange(live), s]
            c = came[at, s]
            state[:live] = np.where(s == 0, c, np.where(c == 1, 0, s))
        found: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(texts)
        for i, o in enumerate(order.tolist()):
            found[o] = labels[start[i] : start[i] + lens[i]]
        return found

    def _emissions(
        self, points: np.ndarray, first: np.ndarray, start: np.ndarray, lens: np.ndarray, wins: np.ndarray, place: np.ndarray, states: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of every character in its text's states, and where a state can't be entered."""
        log, total = self.model.log, len(points)
        space = self.model.ids(np.array([32]))[0]
        text = np.repeat(np.arange(len(lens)), lens)

        def score(ids: np.ndarray, last: np.ndarray, begin: np.ndarray) -> np.ndarray:
            before = np.r_[space, last[:-1]]
            before[begin] = space
            return log[before, ids]

        def numbers(read: np.ndarray) -> np.ndarray:
            seen, back = np.unique(read, return_inverse=True)
            return self.model.ids(seen)[back]

        emit, closed = np.full((total, states + 1), -1e30, np.float32), np.ones((total, states), bool)
        own = numbers(points)
        emit[:, 0] = score(own, own, first)
        for k in np.flatnonzero(wins.any(0)).tolist():
            kind, mine = self.pairs[k][0], np.flatnonzero(wins[:, k])
            at = np.repeat(start[mine] - (np.cumsum(lens[mine]) - lens[mine]), lens[mine]) + np.arange(lens[mine].sum())
            here, begin = points[at], first[at]
            uniq, code = np.unique(here, return_inverse=True)
            read, more, second = self._decoded(k, here, uniq, code, begin)
            ids = numbers(read)
            last = ids if second is None else np.where(second >= 0, self.model.ids(np.maximum(second, 0)), ids)
            e = score(ids, last, begin)
            if second is not None:
                e = e + np.where(second >= 0, log[ids, last], 0)
            e = np.where(read < 0, INVALID, e)
            if kind == "lost":
                e = np.where(here == 0xFFFD, -1.0, e)
            e[more] = 0
            shut = more | (read < 0)
            if kind == "lost":
                shut = here != 0xFFFD
            elif kind != "swap":
                shut |= here < 128  # a span begins with something that was garbled
            slot = place[text[at], k]
            emit[at, slot + 1], closed[at, slot] = e, shut
        return emit, closed

    def _undo(self, text: str, state: int) -> tuple[str, bool]:
        kind, w, t = self.pairs[state - 1]
        points = _points(text)
        if kind == "lost":
            return text, False
        first = np.zeros(len(points), bool)
        first[:1] = True
        uniq, code = np.unique(points, return_inverse=True)
        read, more, second = self._decoded(state - 1, points, uniq, code, first)
        out, whole = [], True
        for i, p in enumerate(read.tolist()):
            if p < 0:
                out.append(text[i])
                whole = False
            elif not more[i]:
                out.append(chr(p))
                if second is not None and second[i] >= 0:
                    out.append(chr(int(second[i])))
        return "".join(out), whole

    def restore(self, texts: list[str]) -> tuple[list[tuple[list[str], str, bool]], np.ndarray]:
        """For each text the pairs that were undone, the outcome, and whether nothing in it is left garbled.

        Then, for each text, whether it is fit to train on: not undone, and without a likely unit of misread UTF-8.
        """
        state = [([], t, True) for t in texts]
        todo = [i for i, t in enumerate(texts) if not t.isascii()]
        fit = np.ones(len(texts), bool)
        seen = {i: {texts[i]} for i in todo}
        first = True
        while todo:  # every layer makes a text likelier; one that comes back to an earlier form is left
            units, wins = self.suspects([state[i][1] for i in todo])
            if first:
                fit[np.array(todo)[units]] = False
                first = False
            # texts with as many pairs that could win are labelled together
            order = [k for k in np.argsort(wins.sum(1), kind="stable").tolist() if wins[k].any()]
            upto = np.cumsum([len(state[todo[k]][1]) for k in order]) // BATCH
            edges = np.flatnonzero(np.diff(upto, prepend=-1)).tolist()
            for a, b in zip(edges, [*edges[1:], len(order)]):
                rows = order[a:b]
                part = [todo[k] for k in rows]
                for i, labels in zip(part, self.label([state[i][1] for i in part], wins[rows])):
                    if not labels.any():
                        continue
                    names, text, whole = state[i]
                    cut = np.r_[0, np.flatnonzero(labels[1:] != labels[:-1]) + 1, len(labels)]
                    out = []
                    for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                        piece = text[x:y]
                        if labels[x]:
                            piece, good = self._undo(piece, int(labels[x]))
                            whole = whole and good
                            names = [*names, ">".join(self.pairs[labels[x] - 1][2:0:-1])]
                        out.append(piece)
                    state[i] = (names, "".join(out), whole)
            # only text that changed in this round is read again
            todo = [i for i in todo if state[i][0] and state[i][2] and not state[i][1].isascii() and state[i][1] not in seen[i]]
            for i in todo:
                seen[i].add(state[i][1])
        fit &= np.array([not s[0] for s in state], bool)
        return state, fit


def _char_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = _points(" ".join(t for t in batch.column(0).to_pylist() if t))
        c, n = np.unique(points, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(n)], ["c", "n"])


def train(texts: DataFrame, column: str) -> Model:
    """A bigram model of a column over all rows; its size is bounded by the alphabet and the blocks of code points there are."""
    counted = texts.select(column).mapInArrow(_char_counts, "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
    chars = counted.orderBy(F.desc("n"), "c").limit(ALPHABET).collect()
    known = np.array(sorted(r["c"] for r in chars), np.int64)
    found = counted.groupBy(F.expr(f"c div {SPAN}").alias("block")).agg(F.collect_set(F.col("c").cast("long")).alias("c")).collect()  # code points, by block
    rest = {r["block"]: n for r in found if (n := len(set(r["c"]) - set(known.tolist())))}
    blocks = np.array(sorted(rest), np.int64)
    alphabet = Alphabet(known, blocks, np.array([rest[b] for b in blocks.tolist()]))
    size = alphabet.size

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = alphabet.ids(_points(" " + " ".join(t for t in batch.column(0).to_pylist() if t)))
            pair, n = np.unique(ids[:-1] * size + ids[1:], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    counts = texts.select(column).mapInArrow(bigrams, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    dense = np.zeros(size * size, np.float32)
    dense[counts["pair"].to_numpy(np.int64)] = counts["n"].to_numpy(np.float32)
    return Model(alphabet, dense.reshape(size, size))


def _apply(texts: DataFrame, key: str, column: str, model: Model) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast((model.alphabet.chars, model.alphabet.blocks, model.alphabet.share, model.log, model.single))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Model.__new__(Model)
        chars, blocks, share, own.log, own.single = sent.value
        own.best = own.log.max(0)
        own.alphabet = Alphabet(chars, blocks, share)
        labeller = Labeller(own)
        for frame in frames:
            found, fit = labeller.restore(frame[column].tolist())
            yield pd.DataFrame(
                {
                    key: frame[key], "text": frame[column], "fit": fit, "pairs": [x[0] for x in found],
                    "restored": [x[1] if x[2] else None for x in found]
                }
            )

    return texts.mapInPandas(run, f"{key} long, text string, fit boolean, pairs array<string>, restored string")


def garbled(rows: DataFrame, key: str, column: str) -> DataFrame:
    """The rows with garbled text: key, text, pairs (``true>read as``, in the order they were undone), restored.

    ``restored`` is null where bytes were lost on the way (replacement characters, unmapped bytes). Null and empty
    texts are clean; repeated rows are looked at once; no rows give no rows.
    """
    # labelling is all computation: texts are spread over all cores however few bytes they are, over more parts the more they are
    wanted = rows.where(F.col(key).isNotNull() & (F.length(column) > 0)).select(key, column)
    stored = int(str(wanted._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if stored >= 1 << 60:  # unknown
        stored = wanted.agg(F.sum(F.octet_length(column))).collect()[0][0] or 0
    tasks = max(3 * rows.sparkSession.sparkContext.defaultParallelism, stored // PART)
    texts, _ = written(wanted.repartition(tasks, key, column).distinct(), "texts")
    first, _ = written(_apply(texts, key, column, train(texts, column)).select("text", "fit"), "labelled")
    return _apply(texts, key, column, train(first.where("fit"), "text")).where("size(pairs) > 0").drop("fit")
