"""Packing documents into fixed token sequences: first-fit decreasing in random groups.

Every document is tokenized where it lies and cut into full sequences and one
remainder. Only the pieces' sizes travel, to randomised groups of documents; each
group packs its pieces first-fit decreasing, finding the first sequence with room by
a tournament tree of free capacities. Groups are independent, so they scale out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import byte_values, give_back, hashes, mix, parts, space_class, spans, tidy, utf8

PIECES = "group int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def worker_cache(owner: str) -> dict:
    """Survives from task to task in one Python worker, until another operator's task begins there; then its memory goes back."""
    import gc
    import sys
    import types

    cache = sys.modules.setdefault("_rushes_worker", types.ModuleType("_rushes_worker")).__dict__
    if cache.get("owner") != owner:
        cache.clear()
        gc.collect()
        give_back()
        cache["owner"] = owner
    return cache


class Recent(dict):
    """A dictionary of about `most` to twice as many entries, those used lately; it lasts as long as its Python worker."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def refresh(self, keys):
        """Makes room, takes over the keys that are known from before, and returns the others."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        older, new = self.older, []
        for k in keys:
            if k not in self:
                found = older.get(k)
                if found is None:
                    new.append(k)
                else:
                    self[k] = found
        return new


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1 ... of size[0] values, then those of the next."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class WordTokens:
    """Token ids of texts, each distinct word encoded once.

    The tokenizer drops white space, so words between ASCII white space are encoded
    apart with the same result. It also lowers letters, and parts a stop or comma from
    the letter before it; so words are told apart by 64 bits of a hash of their bytes
    with A-Z in lower case, without a last stop or comma. Words that hold a special
    token in any case are told apart by their bytes as they are. The ids of all known
    words lie in one array; a text's ids are gathered from it by an offset table. What
    is kept is bounded by most_bytes: beyond it, the table starts anew.
    """

    def __init__(self, content: str, most_bytes: int = 64 << 20, together: int = 256):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most_bytes, self.together = Tokenizer.from_str(content), most_bytes, together
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(re.escape(t.lower()) for t in special).encode()) if special else None
        # words of other bytes, ASCII signs and letters to U+00FF, can be encoded together, joined by blanks
        self.odd = np.ones(256, bool)
        self.odd[33:127] = self.odd[128:192] = self.odd[0xC3] = False
        self.odd[ord("<")] = True
        self.lower, self.exact, self.inside = byte_values(lower=True), mix(byte_values()), space_class()
        self.letter = np.zeros(256, bool)
        self.letter[65:91] = self.letter[97:123] = True
        self.forget()

    def forget(self):
        self.keys, self.begin, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, keys: np.ndarray, data: np.ndarray, s: np.ndarray, e: np.ndarray):
        """keys: ascending, none of them known; s and e: where such words stand."""
        size, begin = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        ids, total = [self.pool], len(self.pool)
        lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)]
        odd = np.r_[0, np.cumsum(self.odd[data], dtype=np.int32)]
        plain = odd[e] == odd[s]
        others = np.flatnonzero(~plain)
        found = self.tokenizer.encode_batch([data[x:y].tobytes().decode() for x, y in zip(s[others].tolist(), e[others].tolist())], add_special_tokens=False)
        for i, x in zip(others.tolist(), found):
            ids.append(np.array(x.ids, np.uint32))
            begin[i], size[i] = total, len(ids[-1])
            total += len(ids[-1])
        groups, texts = np.array_split(np.flatnonzero(plain), -(-int(plain.sum()) // self.together) or 1), []
        for group in groups:
            x, y = s[group], e[group]
            text = data[np.minimum(ranges(x, y - x + 1), len(data) - 1)]
            text[np.cumsum(y - x + 1) - 1] = 32
            texts.append(text.tobytes().decode())
        for group, x in zip(groups, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            ids.append(np.array(x.ids, np.uint32))
            cuts = np.searchsorted(np.array([c for c, _ in x.offsets], np.int64), np.cumsum(lead[e[group]] - lead[s[group]] + 1))
            size[group] = np.diff(cuts, prepend=0)
            begin[group] = total + np.r_[np.zeros(1, np.int64), cuts][: len(group)]
            total += len(ids[-1])
        self.pool = np.concatenate(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.size = np.insert(self.keys, at, keys), np.insert(self.begin, at, begin), np.insert(self.size, at, size)

    def words(self, data: np.ndarray, offsets: np.ndarray):
        """Starts and ends of the words and of stops and commas at their ends, the first of each text, and all keys."""
        s, e, bounds = spans(data, offsets, self.inside)
        last = data[e - 1]
        parted = np.flatnonzero(((last == 46) | (last == 44)) & (e - s > 1))
        parted = parted[self.letter[data[e[parted] - 2]]]
        ends = e.copy()
        ends[parted] -= 1
        s, e = np.insert(s, parted + 1, e[parted] - 1), np.insert(ends, parted + 1, e[parted])
        bounds = bounds + np.searchsorted(parted, bounds)
        keys = hashes(data, s, e, self.lower)
        if self.special:
            found = [m.start() for m in self.special.finditer(data.tobytes().lower())]
            if found:
                w = np.unique(np.searchsorted(s, found, side="right") - 1)
                keys[w] = hashes(data, s[w], e[w], self.exact)
        return s, e, bounds, keys

    def __call__(self, data: np.ndarray, offsets: np.ndarray, end_id: int):
        """The ids of each text and the end id after each, in one array; and where each text's begin."""
        s, e, bounds, keys = self.words(data, offsets)
        found, first, place = np.unique(keys, return_index=True, return_inverse=True)
        if self.keys.nbytes * 3 + self.pool.nbytes > self.most_bytes:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, found), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != found) if len(self.keys) else np.arange(len(found))
        if len(new):
            self.learn(found[new], data, s[first[new]], e[first[new]])
            at = np.searchsorted(self.keys, found)
        # the end id is one entry more, after each text
        begin, size = np.r_[self.begin[at], len(self.pool)], np.r_[self.size[at], 1]
        entry = np.insert(place, bounds[1:], len(found))
        size = size[entry]
        ids = np.r_[self.pool, np.uint32(end_id)].astype("<u4")[ranges(begin[entry], size)]
        return ids, np.r_[0, np.cumsum(size)][np.r_[0, bounds[1:] + np.arange(1, len(bounds))]]


def text_blocks(data: np.ndarray, offsets: np.ndarray, size: int = 2 << 20):
    """(text from, text to, bytes, offsets, whole) of runs of about so many bytes; a longer text is cut at white space, and all but its last block aren't whole."""
    space = ~space_class()
    a = 0
    while a < len(offsets) - 1:
        if offsets[a + 1] - offsets[a] <= 2 * size:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
            yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], True
            a = b
        else:
            x, end = int(offsets[a]), int(offsets[a + 1])
            while x < end:
                y = min(x + size, end)
                while y < end and not space[data[y]]:
                    step = np.flatnonzero(space[data[y : min(y + 65536, end)]])
                    y = y + int(step[0]) if len(step) else min(y + 65536, end)
                yield a, a + 1, data[x:y], np.array([0, y - x]), y == end
                x = y
            a += 1


class Capacities:
    """Tournament tree over bins: each node has the most room of the bins below it."""

    def __init__(self, n: int, room: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.most = [room] * (2 * self.size)

    def first(self, need: int) -> int:
        """The first bin with room; takes it."""
        most, at = self.most, 1
        while at < self.size:
            at *= 2
            if most[at] < need:
                at += 1
        bin_ = at - self.size
        most[at] -= need
        while at > 1:
            at //= 2
            left, right = most[2 * at], most[2 * at + 1]
            now = left if left > right else right
            if most[at] == now:
                break
            most[at] = now
        return bin_


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each piece."""
    order = np.argsort(-lengths, kind="stable")
    tree = Capacities(max(len(lengths), 1), room)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        bins[i] = b = tree.first(n)
        offsets[i] = room - tree.most[tree.size + b] - n
    return bins, offsets


def pieces(content: str, groups: int, room: int, end_id: int):
    """Task function: texts to the pieces of their token ids."""

    def run(rows):
        import struct
        import zlib

        from pyspark import TaskContext

        cache, key = worker_cache("packing"), hash(content)
        if key not in cache:
            cache[key] = WordTokens(content)
        encode = cache[key]
        context = TaskContext.get()
        task = context.partitionId() if context else 0
        for batch in (part for batch in rows for part in parts(batch, "text")):
            names = batch.schema.names
            own = batch.column(names.index("id")).to_pylist()
            data, offsets = utf8(batch.column(names.index("text")))
            out: list[tuple] = []
            held: list[np.ndarray] = []
            for a, b, part, bound, whole in text_blocks(data, offsets):
                ids, at = encode(part, bound, end_id)
                if not whole:
                    held.append(ids[:-1])
                    continue
                if held:
                    ids = np.concatenate([*held, ids])
                    at, held = np.array([0, len(ids)]), []
                raw = memoryview(ids).cast("B")
                for i, x, y in zip(own[a:b], at[:-1].tolist(), at[1:].tolist()):
                    cuts = [(c, min(c + room, y)) for c in range(x, y, room)]
                    crcs = [zlib.crc32(raw[4 * c : 4 * d]) for c, d in cuts]
                    # a document's pieces share a group, which id, ids and task choose
                    group = zlib.crc32(struct.pack(f"<qqQ{len(crcs)}I", task, y - x, (i or 0) & 0xFFFFFFFFFFFFFFFF, *crcs)) % groups
                    out += [(group, i, c - x, d - c, crc, y - x) for (c, d), crc in zip(cuts, crcs)]
            types = (pa.int32(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=["group", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def packed(room: int):
    """Task function for one group: its pieces to their sequences."""

    def run(table: pa.Table) -> pa.Table:
        group = table.column("group")[0].as_py()
        keys = [table.column(n).combine_chunks() for n in ("doc_id", "start", "ids_crc32")]
        order = np.lexsort([k.fill_null(-(2**63)).to_numpy(zero_copy_only=False) for k in reversed(keys)])
        table = table.take(pa.array(order))
        bins, offsets = first_fit_decreasing(table.column("length").combine_chunks().to_numpy(), room)
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array((np.int64(group) << 32) + bins)).append_column("offset", pa.array(offsets))

    return run


def check_tokenizer(content: str):
    """ValueError for a tokenizer that words can't be encoded apart by, as WordTokens does it."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    if ids("Us us") != ids("us") * 2 or any(ids(f"us{sign}") != ids("us") + ids(sign) for sign in ".,") or ids(" us\n\tus ") != ids("us us"):
        raise ValueError("the tokenizer must lower letters, drop white space and part a last stop or comma")


def pack_documents(docs: DataFrame, content: str, id_column: str = "doc_id", text_column: str = "text", room: int = 2048, end_id: int = 1, group_rows: int = 2048) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    content is a tokenizer file's content, whose tokenizer must drop white space, lower
    letters and part a last stop or comma from its word; another raises ValueError.
    group_rows is how many documents a group packs on average.

    Null or empty text: the end id alone. Null id: packed like any other, with null
    as its doc_id. Rows that repeat an id or a text are packed once each; rows that
    repeat both spread over groups by task, the same way if a task runs again. A text
    of any length is cut into pieces. An empty table gives an empty one. Other columns
    are not read, so their names don't matter.
    """
    check_tokenizer(content)
    groups = max(1, -(-docs.count() // group_rows))
    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    return texts.mapInArrow(tidy(pieces(content, groups, room, end_id)), PIECES).groupBy("group").applyInArrow(packed(room), PACKED)
