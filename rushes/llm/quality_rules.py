"""Quality rules: how much of a text stands in repeated word n-grams and lines.

Rolling hashes of several n-gram lengths, for a whole batch of texts at once in
numpy; an n-gram repeats if its hash occurs twice in one text. Coverage counts the
characters of words inside repeated n-grams, and of repeated lines, once each.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import map_texts
from ._text import byte_values, hashes, mix, powers, space_class, spans, utf8
from .line_dedup import _lines

SYMBOLS = "#*$%&|<>"
#: Largest share of word characters in repeated n-grams, by n, and in repeated lines.
MOST_REPEATED = {5: 0.40, 6: 0.38, 8: 0.36, 10: 0.34}
MOST_LINES, MOST_SYMBOLS = 0.40, 0.10
COLUMNS = "_n_words long, _word_chars long, _n_symbols long, _n_dup_lines long, _n_repeat_words long, _base_failed boolean, _kept boolean, _repeated_share array<double>, _line_share double"


def repeated_words(words: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """True for the words inside an n-gram that occurs twice or more in its text."""
    out = np.zeros(len(words), bool)
    last = bounds[1:] - n
    ok = last >= bounds[:-1]
    if not ok.any():
        return out
    base = powers(n, 0x9FB21C651E98DF25)
    size = len(words) - n + 1
    value = np.zeros(size, np.uint64)
    for k in range(n):
        value += words[k : k + size] * base[k]
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:size]
    whole = np.arange(size) <= last[owner]
    at = np.flatnonzero(whole)
    value = mix(value[at] ^ mix(owner[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    many = at[order[np.r_[False, same] | np.r_[same, False]]]
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, many, 1)
    np.add.at(edge, many + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _sums(values, bounds):
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[bounds[1:]] - total[bounds[:-1]]


def apply_quality_rules(docs: DataFrame, text_column: str = "text", lengths: dict[int, float] = MOST_REPEATED, most_lines: float = MOST_LINES, most_symbols: float = MOST_SYMBOLS) -> DataFrame:
    """docs with the columns of COLUMNS in place of the text.

    Words are runs without ASCII white space. The base rule fails a text of under 20
    words, or with over 30 % of its words in 8-word windows that occur twice. The
    method's verdict also drops a text with a larger share of characters in repeated
    n-grams or lines than the limits, or with more symbols for each word character.

    Null or empty text: no words, failed. One word of any length counts once. Ties and
    repeated rows: each row is judged by itself. An empty table gives an empty one. Own
    columns stay, whatever their names; one named as a new column gives way to it.
    """

    def run(rows):
        inside, values = space_class(), byte_values()
        symbol = np.zeros(256, bool)
        symbol[[ord(c) for c in SYMBOLS]] = True

        def judge(column):
            data, offsets = utf8(column)
            s, e, bounds = spans(data, offsets, inside)
            words = hashes(data, s, e, values)
            lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
            chars = lead[e] - lead[s]
            word_chars = _sums(chars, bounds)
            n_words = np.diff(bounds)
            symbols = _sums(symbol[data], offsets)
            eight = repeated_words(words, bounds, 8)
            n_repeat = _sums(eight, bounds)
            shares = []
            for n in lengths:
                shares.append(_sums(np.where(eight if n == 8 else repeated_words(words, bounds, n), chars, 0), bounds) / np.maximum(word_chars, 1))
            _, ls, le, owner, line_bound = _lines(column)
            word_from = np.searchsorted(s, ls)
            has = np.searchsorted(s, le) > word_from
            h1, h2 = hashes(data, ls, le, values), hashes(data, ls, le, mix(values))
            order = np.lexsort((np.arange(len(ls)), h2, h1, owner))
            order = order[has[order]]
            again = np.zeros(len(ls), bool)
            if len(order):
                same = (owner[order][1:] == owner[order][:-1]) & (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1]) & ((le - ls)[order][1:] == (le - ls)[order][:-1])
                again[order[1:][same]] = True
            total = np.r_[0, np.cumsum(chars)]
            line_chars = np.where(again, total[np.searchsorted(s, le)] - total[word_from], 0)
            line_share = _sums(line_chars, line_bound) / np.maximum(word_chars, 1)
            failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
            kept = ~failed & (line_share <= most_lines) & (symbols <= most_symbols * word_chars)
            for share, most in zip(shares, lengths.values()):
                kept &= share <= most
            grid = np.stack(shares, 1) if shares else np.zeros((len(column), 0))
            repeated = pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1) * grid.shape[1], pa.int32()), pa.array(grid.ravel()))
            return [pa.array(x, t) for x, t in ((n_words, pa.int64()), (word_chars, pa.int64()), (symbols, pa.int64()), (_sums(again, line_bound), pa.int64()), (n_repeat, pa.int64()), (failed, pa.bool_()), (kept, pa.bool_()))] + [repeated, pa.array(line_share)]

        for batch in rows:
            # a bounded number of bytes at a time
            _, offsets = utf8(batch.column(batch.schema.get_field_index("_whole")))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (2 << 20), side="right")) - 1)
                part = batch.slice(a, b - a)
                out = {f: part.column(i) for i, f in enumerate(part.schema.names) if f != "_whole"}
                out |= dict(zip([c.split()[0] for c in COLUMNS.split(", ")], judge(part.column(part.schema.get_field_index("_whole")))))
                yield pa.RecordBatch.from_pydict(out)
                a = b

    return map_texts(docs, text_column, run, COLUMNS)
