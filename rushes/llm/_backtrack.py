"""Backtracking over Aho-Corasick matches, for one text or for many words at once.

Units are tokens, or letters that stand for tokens. A sequence of units is the
encoding exactly if each two neighbours may stand side by side, and what stands before
a place is the encoding of that prefix. So the longest unit at a place is tried first,
then shorter ones; where none fits, the place has failed for good, a bitfield keeps it,
and its last unit gives way. Many words go through the same steps together in numpy.

Most matches are of one or two characters; tables of characters and of pairs of them
say those for a whole text at once, the automaton has the longer units.
"""

from itertools import chain

import numpy as np

#: Characters of words that go through the steps together, and of the longest word among them.
TOGETHER, LONGEST = 1 << 18, 64
SLOTS = 21
#: Different characters in units of two, for which there is a table of all pairs.
PAIRED = 1024


class Pairs:
    """Whether two units may stand side by side, asked for many pairs at once: a table of slots before a dictionary before the question itself."""

    def __init__(self, compatible, most: int):
        self.compatible, self.most = compatible, most
        self.keys, self.values = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, bool)
        self.known: dict[int, bool] = {}

    def one(self, left: int, right: int) -> bool:
        code = left << 32 | right
        fit = self.known.get(code)
        if fit is None:
            if len(self.known) > self.most:
                self.known.clear()
            fit = self.known[code] = self.compatible(left, right)
        return fit

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left << 32 | right
        slot = ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != code)
        if len(miss):
            asked, place = np.unique(code[miss], return_inverse=True)
            out[miss] = np.array([self.one(c >> 32, c & 0xFFFFFFFF) for c in asked.tolist()])[place]
            # of pairs with one slot the last stays
            self.keys[slot[miss]], self.values[slot[miss]] = code[miss], out[miss]
        return out


class Backtracker:
    """texts: each unit's characters, '' for numbers that are none. Every character of what is encoded must be a unit."""

    def __init__(self, texts: list[str], compatible, most: int, apart: str):
        import ahocorasick

        number = {t: k for k, t in enumerate(texts) if t}
        self.apart = apart
        self.pairs = Pairs(compatible, most)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.shorter = np.array([next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in texts], np.int64)
        paired = sorted({ord(c) for t in number if len(t) == 2 for c in t})
        tabled = 2 if len(paired) <= PAIRED else 1
        # by code point: the unit of that character, and its place among those in units of two; the last stands for all code points beyond
        last = max(map(ord, chain.from_iterable(number)), default=0) + 1
        self.singles, self.place = np.full(last + 1, -1, np.int32), np.zeros(last + 1, np.int32)
        if tabled == 2:
            self.place[paired] = np.arange(1, len(paired) + 1)
        self.doubles = np.full((len(paired) + 1, len(paired) + 1) if tabled == 2 else (1, 1), -1, np.int32)
        self.machine = ahocorasick.Automaton()
        for t, k in number.items():
            if len(t) == 1:
                self.singles[ord(t)] = k
            elif len(t) <= tabled:
                self.doubles[tuple(self.place[[ord(c) for c in t]])] = k
            else:
                self.machine.add_word(t, k)
        self.machine.make_automaton()

    def longest(self, text: str) -> np.ndarray:
        """The longest unit that begins at each place, -1 where none does."""
        code = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), len(self.singles) - 1)
        out = np.full(len(text) + 1, -1, np.int64)
        out[:-1] = self.singles[code]
        place = self.place[code]
        double = self.doubles[place[:-1], place[1:]]
        at = np.flatnonzero(double >= 0)
        out[at] = double[at]
        if len(self.machine):
            found = np.fromiter(chain.from_iterable(self.machine.iter(text)), np.int64).reshape(-1, 2)
            # matches come by their ends, so of those with one begin the last is the longest
            out[found[:, 0] - self.sizes[found[:, 1]] + 1] = found[:, 1]
        return out

    def one(self, text: str) -> list[int]:
        """Units of a text."""
        if not text:
            return []
        n = len(text)
        longest, sizes, shorter, fits = self.longest(text).tolist(), self.sizes, self.shorter, self.pairs.one
        failed = bytearray((n >> 3) + 1)
        taken: list[int] = []
        at, unit = 0, longest[0]
        while at < n:
            last = taken[-1] if taken else -1
            while unit >= 0:
                end = at + int(sizes[unit])
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or fits(last, unit)):
                    break
                unit = int(shorter[unit])
            if unit >= 0:
                taken.append(unit)
                at = end
                unit = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                taken.pop()
                at -= int(sizes[last])
                unit = int(shorter[last])
        return taken

    def many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(units of all words one after the other, how many each word has)."""
        units, counts = [], []
        k = 0
        while k < len(words):
            if len(words[k]) > LONGEST:
                found = self.one(words[k])
                units.append(np.array(found, np.int64)), counts.append(np.array([len(found)]))
                k += 1
                continue
            first, size = k, 0
            while k < len(words) and size < TOGETHER and len(words[k]) <= LONGEST:
                size += len(words[k])
                k += 1
            u, c = self._together(words[first:k])
            units.append(u), counts.append(c)
        none = np.zeros(0, np.int64)
        return np.concatenate(units) if units else none, np.concatenate(counts) if counts else none

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(size + 1) - (size + 1)
        stop = start + size
        text = self.apart.join(words)
        longest = self.longest(text)
        sizes, shorter = self.sizes, self.shorter
        ending = np.full(len(text) + 1, -1, np.int64)  # the unit that ends at a place
        failed = np.zeros((len(text) >> 3) + 1, np.uint8)
        at, unit = start.copy(), longest[start]
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            a, u = at[open_], unit[open_]
            last = np.where(a > start[open_], ending[a], -1)
            end = np.minimum(a + sizes[u], len(text))  # of no unit it means nothing
            fit = (u >= 0) & ((failed[end >> 3] >> (end & 7).astype(np.uint8)) & 1 == 0)
            ask = np.flatnonzero(fit & (last >= 0))
            if len(ask):
                fit[ask] = self.pairs(last[ask], u[ask])
            taken = open_[fit]
            ending[end[fit]] = u[fit]
            at[taken] = end[fit]
            unit[taken] = longest[end[fit]]
            less = ~fit & (u >= 0)
            unit[open_[less]] = shorter[u[less]]
            stuck = ~fit & (u < 0)
            if stuck.any():
                w, a, u = open_[stuck], a[stuck], last[stuck]
                np.bitwise_or.at(failed, a >> 3, (1 << (a & 7)).astype(np.uint8))
                at[w] = a - sizes[u]
                unit[w] = shorter[u]
            open_ = open_[at[open_] < stop[open_]]
        ends = np.zeros(len(text) + 1, bool)
        back, place = np.flatnonzero(size), stop[size > 0]
        while len(back):
            ends[place] = True
            place = place - sizes[ending[place]]
            more = place > start[back]
            back, place = back[more], place[more]
        ends = np.flatnonzero(ends)
        return ending[ends], np.searchsorted(ends, stop, side="right") - np.searchsorted(ends, start, side="right")


def packed_words(units: np.ndarray, counts: np.ndarray, codes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Ids of each word, little-endian 32-bit: unit u has the ids codes[bounds[u]:bounds[u + 1]]."""
    many = bounds[units + 1] - bounds[units]
    total = np.cumsum(many)
    ids = codes[np.repeat(bounds[units] - (total - many), many) + np.arange(int(total[-1]) if len(total) else 0)].astype("<u4").tobytes()
    ends = np.r_[0, total][np.cumsum(counts)] * 4
    return [ids[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]
