"""License scans: phrases word by word, and short notices with a bounded number of edits.

A notice with at most k edits keeps one of its k + 1 pieces whole (pigeonhole), so
exact pieces, looked for in one Aho-Corasick pass, locate every candidate; the
regex library's bounded-error matching then verifies the edits around each and
gives the span.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import map_texts
from ._text import spans, utf8
from .substring_dedup import _packed

#: Phrases of words and their labels (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices of public licences, as lower-case words, and their labels (fixed values).
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-notice",
    "licensed under the apache license version 2 0": "apache-notice",
    "free software you can redistribute it and or modify it under the terms of the gnu": "gnu-notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-notice",
    "permission to use copy modify and or distribute this software for any purpose": "isc-notice",
    "subject to the terms of the mozilla public license": "mpl-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "licensed under a creative commons attribution": "cc-notice",
    "all rights reserved": "rights-reserved",
}
SCANNED = "_n_words long, _n_base long, _first_word long, _last_word long, _base_labels string, _labels string, _score double, _notices array<struct<label:string,first_word:long,n_words:long,edits:int>>"


def word_class() -> np.ndarray:
    """True for the bytes of letters, digits and characters outside ASCII."""
    inside = np.zeros(256, bool)
    inside[48:58] = inside[65:91] = inside[97:123] = inside[128:] = True
    return inside


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of nearly one length that make up the notice, with their places."""
    cuts = np.linspace(0, len(notice), edits + 2).round().astype(int).tolist()
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str], edit_share: float):
        import ahocorasick
        import regex

        self.phrases = phrases
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (notice, label) in enumerate(notices.items()):
            edits = int(len(notice) * edit_share)
            self.notices.append((notice, label, edits, regex.compile(f"(?be)({regex.escape(notice, special_only=True)}){{e<={edits}}}")))
            for place, piece in pieces(notice, edits):
                seeds.setdefault(piece, []).append((n, place))
        self.machine = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.machine.add_word(piece, (len(piece), where))
        if seeds:
            self.machine.make_automaton()

    def phrase_places(self, text: bytes) -> list[tuple[int, str]]:
        """(byte, label) where a phrase's words stand; words are joined by one blank, texts by a line feed."""
        out = []
        for phrase, label in self.phrases.items():
            phrase = phrase.encode()
            at = text.find(phrase)
            while at >= 0:
                end = at + len(phrase)
                if (at == 0 or text[at - 1] in b" \n") and (end == len(text) or text[end] in b" \n"):
                    out.append((at, label))
                at = text.find(phrase, at + 1)
        return sorted(out)

    def notice_places(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of the notices, the best match at each place; text is Latin-1 of the bytes."""
        windows: dict[int, list[tuple[int, int]]] = {}
        if len(self.machine):
            for end, (size, where) in self.machine.iter(text):
                for n, place in where:
                    notice, _, edits, _ = self.notices[n]
                    start = end - size + 1 - place
                    windows.setdefault(n, []).append((max(0, start - edits), start + len(notice) + edits))
        out = []
        for n, places in windows.items():
            notice, label, edits, pattern = self.notices[n]
            merged: list[list[int]] = []
            for a, b in sorted(places):
                if merged and a < merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                # a text's borders are never crossed
                for part_at, part in _parts(text, a, min(b, len(text))):
                    # the pattern gives the best match first, so others may stand on either side of it
                    open_ = [(0, len(part))]
                    while open_:
                        low, high = open_.pop()
                        m = pattern.search(part, low, high)
                        if m and m.end() > m.start():
                            out.append((part_at + m.start(), part_at + m.end(), label, sum(m.fuzzy_counts)))
                            open_ += [(low, m.start()), (m.end(), high)]
        return sorted(out)


def _parts(text: str, a: int, b: int):
    for part in text[a:b].split("\n"):
        yield a, part
        a += len(part) + 1


def scan_licenses(docs: DataFrame, text_column: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, edit_share: float = 1 / 12) -> DataFrame:
    """docs with `_n_words`, `_n_base`, `_first_word`, `_last_word`, `_base_labels`, `_labels`, `_score` and `_notices` (spans in words, with edits) in place of the text.

    Words are runs of letters, digits and characters outside ASCII, A-Z in lower case.
    A notice is found with up to edit_share of its characters inserted, dropped or
    changed, in the words joined by one blank. The score is 1 with a phrase, else the
    best notice's share of characters without edits, else 0.

    Null or empty text: no words, nothing found, score 0. Long texts are scanned whole;
    ties and repeated rows are scanned row by row. An empty table gives an empty one.
    Own columns stay, whatever their names; one named as a new column gives way to it.
    """

    def run(rows):
        scanner = Scanner(phrases, notices, edit_share)
        length = {label: len(notice) for notice, label in notices.items()}
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        inside = word_class()
        for batch in rows:
            names = batch.schema.names
            column = batch.column(names.index("_whole"))
            data, offsets = utf8(column)
            out = {f: batch.column(i) for i, f in enumerate(names) if f != "_whole"}
            results = [[0, 0, None, None, set(), set(), 0.0, []] for _ in range(len(column))]
            a = 0
            while a < len(column):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 20), side="right")) - 1)
                part, bound = lower[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
                s, e, first = spans(part, bound, inside)
                packed, ps, pe = _packed(part, bound, s, e)
                ends = first[1:][first[1:] > first[:-1]] - 1
                packed[pe[ends]] = 10
                text = packed.tobytes()
                for d, n in enumerate(np.diff(first).tolist()):
                    results[a + d][0] = n
                word_at = lambda x: int(np.searchsorted(ps, x, side="right")) - 1
                text_at = lambda w: int(np.searchsorted(first, w, side="right")) - 1
                for at, label in scanner.phrase_places(text):
                    w = word_at(at)
                    d = text_at(w)
                    r = results[a + d]
                    w -= int(first[d])
                    r[1] += 1
                    r[2], r[3] = w if r[2] is None else min(r[2], w), w if r[3] is None else max(r[3], w)
                    r[4].add(label), r[5].add(label)
                    r[6] = 1.0
                for x, y, label, edits in scanner.notice_places(text.decode("latin-1")):
                    w, v = word_at(x), word_at(max(x, y - 1))
                    d = text_at(w)
                    r = results[a + d]
                    r[5].add(label)
                    r[6] = max(r[6], 1 - edits / length[label])
                    r[7].append({"label": label, "first_word": w - int(first[d]), "n_words": v - w + 1, "edits": edits})
                a = b
            joined = lambda x: ",".join(sorted(x))
            for i, (name, kind) in enumerate((("_n_words", pa.int64()), ("_n_base", pa.int64()), ("_first_word", pa.int64()), ("_last_word", pa.int64()), ("_base_labels", pa.string()), ("_labels", pa.string()), ("_score", pa.float64()))):
                out[name] = pa.array([joined(r[i]) if i in (4, 5) else r[i] for r in results], kind)
            out["_notices"] = pa.array([r[7] for r in results], pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())])))
            yield pa.RecordBatch.from_pydict(out)

    return map_texts(docs, text_column, run, SCANNED)
