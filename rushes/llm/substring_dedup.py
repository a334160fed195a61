"""Substring dedup: every repeated window of k words goes, wherever it was not first.

Super-k-mer partitioning: each window has a minimiser, the least hash of its
m-word pieces. Consecutive windows that share it travel as one packed string to
the minimiser's bucket; equal windows meet there, because equal windows have
equal minimisers. Within a bucket, sorting brings equal windows together and the
first of them in (document, position) order stays.

A piece that is the minimiser of a large part of all windows would fill one bucket.
Such pieces are counted beforehand, over all texts, and come last in the order: a
window around one goes by another of its pieces, so its bucket is split by content.

Copies are reduced before they travel: a task sends each packed string once,
with its first place; its other places are known to be repeats without asking.
So a passage found in a third of all documents costs its bucket one string for
each task's block, not one for each document.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import buckets, column, own_fields, text_bytes
from ._text import byte_values, give_back, grams, hashes, mix, parts, powers, space_class, spans, tidy, utf8
from .packing import worker_cache

NO_ID = -(2**63)
STRETCH = "bucket int, ids binary, tags binary, starts binary, counts binary, text binary"
KEPT = {"_kept": T.StringType(), "_n_words": T.LongType(), "_n_removed": T.LongType(), "_sha": T.StringType()}
REPEAT = "id long, tag1 long, tag2 long, start int, n int"
BUCKET_BYTES = 6 << 20
#: Bytes of text, or of compressed text, that a task looks at together; its arrays are many times that.
PART_BYTES, PACKED_BYTES = 1 << 19, 1 << 18
#: Hot pieces are minimisers of 2**-HOT_BITS of all window text at least, so no more than twice 2**HOT_BITS exist.
HOT_BITS = 18


def _packed(data, offsets, starts, ends):
    """The words joined by one space: bytes, and each word's start and end in them."""
    size = ends - starts
    shift = np.cumsum(size + 1) - (size + 1)
    at = np.repeat(starts - shift, size + 1) + np.arange(int((size + 1).sum()))
    at = np.minimum(at, max(len(data) - 1, 0))
    out = data[at] if len(at) else np.zeros(0, np.uint8)
    out[shift + size] = 32
    return out, shift, shift + size


def ranked(piece: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Order of pieces by which the minimiser is chosen: by hash, the hot ones last."""
    rank = piece >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, rank), len(hot) - 1)
        rank[hot[at] == rank] |= np.uint64(1 << 63)
    return rank


def _stretches(words, bounds, k, m, hot):
    """(first window, windows, minimiser) of each maximal run of windows that share a minimiser in one text."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(words) < k:
        return none
    piece = ranked(grams(words, m), hot)
    width = k - m + 1
    least, have = piece, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    inside = np.zeros(len(words) + 1, np.int32)
    last = bounds[1:] - k
    ok = last >= bounds[:-1]
    np.add.at(inside, bounds[:-1][ok], 1)
    np.add.at(inside, last[ok] + 1, -1)
    valid = np.cumsum(inside[:-1])[: len(least)] > 0
    if not valid.any():
        return none
    new = valid.copy()
    new[1:] &= ~(valid[:-1] & (least[1:] == least[:-1]))
    new[bounds[:-1][ok]] = True
    first = np.flatnonzero(new)
    # a run ends where the next begins, or where windows stop being valid
    count = np.add.reduceat(valid.astype(np.int64), first)
    return first, count, least[first]


def loads(k: int, m: int, share: float):
    """Task function: (piece, bytes) of the window text that pieces are minimisers of, where it is at least half of share of the task's."""

    def run(rows):
        values, inside = byte_values(), space_class()
        keys, sizes, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in (part for batch in rows for part in parts(batch, "text", PART_BYTES)):
            data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
            s, e, bounds = spans(data, offsets, inside)
            first, count, least = _stretches(hashes(data, s, e, values), bounds, k, m, np.zeros(0, np.uint64))
            if len(first):
                size = e[first + count + k - 2] - s[first]
                total += int(size.sum())
                keys, place = np.unique(np.r_[keys, least], return_inverse=True)
                sizes = np.bincount(place, np.r_[sizes, size], len(keys)).astype(np.int64)
                keep = sizes >= total * share / 4
                keys, sizes = keys[keep], sizes[keep]
        keep = sizes >= total * share / 2
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(sizes[keep])], names=["piece", "size"])

    return run


def hot_pieces(texts: DataFrame, k: int, m: int, total: int) -> np.ndarray:
    """Pieces, ascending, that are minimisers of more window text than a fourth of a bucket, and than one share of the total."""
    limit = max(BUCKET_BYTES // 4, total >> HOT_BITS)
    # a task leaves out less than half of what a hot piece has; at most 2 * total / limit rows remain
    found = texts.mapInArrow(tidy(loads(k, m, min(1.0, limit / max(total, 1)))), "piece long, size long").groupBy("piece").agg(F.sum("size").alias("size"))
    rows = found.where(F.col("size") >= limit // 2).select("piece").toArrow()
    return np.sort(rows.column(0).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def stretches(k: int, m: int, n_buckets: int, block: int, shared):
    """Task function: texts to packed strings by bucket, and to the repeats that are known already."""

    def run(rows):
        import zstandard

        worker_cache("substrings")
        values, inside = byte_values(), space_class()
        compress = zstandard.ZstdCompressor(level=3).compress
        hot, serial = shared.value, 0

        def emit(seen, keys, places):
            nonlocal serial
            number = np.concatenate([p[0] for p in places])
            ids, tags, starts, counts = (np.concatenate([p[i] for p in places]) for i in (1, 2, 3, 4))
            order = np.lexsort((starts, tags[:, 1], tags[:, 0], ids, number))
            number, ids, tags, starts, counts = (x[order] for x in (number, ids, tags, starts, counts))
            lead = np.r_[True, number[1:] != number[:-1]]
            # the same document at the same place, if a row occurs twice, is no repeat
            owner = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))
            again = ~lead & ((ids != ids[owner]) | (tags != tags[owner]).any(1) | (starts != starts[owner]))
            bucket = (np.array(keys, np.uint64) % np.uint64(n_buckets)).astype(np.int64)
            texts = list(seen)
            ids0, tags0, starts0 = ids[lead], tags[lead], starts[lead]
            by = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                w = by[a:b]
                w = w[np.argsort(ids0[w], kind="stable")]
                out.append((int(bucket[w[0]]), compress(np.diff(ids0[w], prepend=np.int64(0)).tobytes()), compress(tags0[w].tobytes()), compress(starts0[w].tobytes()), None, compress(b"\n".join([texts[i] for i in w]))))
            serial += 1
            if again.any():
                w = np.flatnonzero(again)
                out.append(((serial * 7919) % n_buckets, compress(ids[w].tobytes()), compress(tags[w].tobytes()), compress(starts[w].tobytes()), compress(counts[w].tobytes()), None))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 5))], names=["bucket", "ids", "tags", "starts", "counts", "text"])

        seen, keys, places, size = {}, [], [], 0
        for batch in (part for batch in rows for part in parts(batch, "text", PART_BYTES)):
            id_column, tag1, tag2, text = (batch.column(batch.schema.get_field_index(c)) for c in ("id", "tag1", "tag2", "text"))
            data, offsets = utf8(text)
            s, e, bounds = spans(data, offsets, inside)
            first, count, least = _stretches(hashes(data, s, e, values), bounds, k, m, hot)
            if not len(first):
                continue
            packed, ps, pe = _packed(data, offsets, s, e)
            packed = packed.tobytes()
            doc = np.searchsorted(bounds, first, side="right") - 1
            number = np.empty(len(first), np.int64)
            for j, (x, y, key) in enumerate(zip(ps[first].tolist(), pe[first + count + k - 2].tolist(), least.tolist())):
                string = packed[x:y]
                at = seen.get(string)
                if at is None:
                    at = seen[string] = len(keys)
                    keys.append(key)
                    size += y - x
                number[j] = at
            doc_ids, doc_tags = id_column.to_numpy(), np.column_stack([tag1.to_numpy(), tag2.to_numpy()])
            places.append((number, doc_ids[doc], doc_tags[doc], (first - bounds[doc]).astype(np.int32), count.astype(np.int32)))
            if size > block:
                yield emit(seen, keys, places)
                seen, keys, places, size = {}, [], [], 0
        if places:
            yield emit(seen, keys, places)

    return run


def window_sums(word: np.ndarray, k: int) -> np.ndarray:
    """A polynomial sum of each k consecutive values, from sums of powers of two of them; a sum is let go once it is added."""
    base = powers(k + 1, 0xA24BAED4963EE407)
    size = len(word) - k + 1
    total, at, have, window = np.zeros(size, np.uint64), 0, 1, word
    while True:
        if k & have:
            total += base[at] * window[at : at + size]
            at += have
        if have * 2 > k:
            return total
        window = window[: len(window) - have] + base[have] * window[have:]
        have *= 2


def repeats(k: int):
    """Task function for one bucket: its packed strings to the places of windows that occur earlier."""

    def found(table: pa.Table) -> pa.Table:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        values, inside = byte_values(), space_class()
        out = []
        ids, tags, starts, text = [], [], [], []
        for batch in table.to_batches():
            for i, t, s, c, x in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("ids", "tags", "starts", "counts", "text"))):
                i, t, s = np.frombuffer(expand(i), np.int64), np.frombuffer(expand(t), np.int64).reshape(-1, 2), np.frombuffer(expand(s), np.int32)
                if x is None:
                    out.append((i, t, s, np.frombuffer(expand(c), np.int32)))
                else:
                    ids.append(np.cumsum(i)), tags.append(t), starts.append(s), text.append(expand(x))
        if text:
            whole = b"\n".join(text)
            del text
            data = np.frombuffer(whole, np.uint8)
            ids, tags, starts = np.concatenate(ids), np.concatenate(tags), np.concatenate(starts)
            line = np.r_[0, np.flatnonzero(data == 10) + 1, len(data)]
            ws, we, bounds = spans(data, line, inside)
            word = hashes(data, ws, we, values)
            count = np.diff(bounds) - k + 1
            total = window_sums(word, k)
            del word
            # a bucket's text is far below 2**31 bytes, so are its places
            narrow = np.int32 if len(data) < 1 << 31 else np.int64
            ws, we = ws.astype(narrow), we.astype(narrow)
            row = np.repeat(np.arange(len(count), dtype=narrow), count)
            inner = np.arange(len(row), dtype=narrow) - np.repeat((np.cumsum(count) - count).astype(narrow), count)
            place = np.repeat(bounds[:-1].astype(narrow), count) + inner
            value = mix(total[place])
            del total
            order = np.argsort(value)
            ordered = value[order]
            same = ordered[1:] == ordered[:-1]
            many = order[np.r_[False, same] | np.r_[same, False]]
            del order, ordered, same
            if len(many):
                r, s = row[many], starts[row[many]] + inner[many].astype(np.int32)
                sort = np.lexsort((s, tags[r, 1], tags[r, 0], ids[r], value[many]))
                r, s, p, v = r[sort], s[sort], place[many][sort], value[many][sort]
                lead = np.r_[True, v[1:] != v[:-1]]
                owner = np.maximum.accumulate(np.where(lead, np.arange(len(lead)), 0))
                again = np.flatnonzero(~lead)
                x0, x1, y0, y1 = (z.tolist() for z in (ws[p[again]], we[p[again] + k - 1], ws[p[owner[again]]], we[p[owner[again]] + k - 1]))
                equal = np.fromiter((whole[a:b] == whole[c:d] for a, b, c, d in zip(x0, x1, y0, y1)), bool, len(again))
                if not equal.all():  # different windows with one hash: their bytes decide
                    firsts: dict = {}
                    owner = np.array([firsts.setdefault(whole[ws[q] : we[q + k - 1]], j) for j, q in enumerate(p)])
                    again = np.flatnonzero(owner != np.arange(len(owner)))
                o = owner[again]
                again = again[(ids[r[again]] != ids[r[o]]) | (tags[r[again]] != tags[r[o]]).any(1) | (s[again] != s[o])]
                r, s = r[again], s[again]
                sort = np.lexsort((s, r))
                r, s = r[sort], s[sort]
                if len(r):
                    lead = np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)]
                    begin = np.flatnonzero(lead)
                    out.append((ids[r[begin]], tags[r[begin]], s[begin], np.diff(begin, append=len(r)).astype(np.int32)))
        i, t, s, n = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)]
        return pa.table([pa.array(c) for c in (i, t[:, 0], t[:, 1], s, n)], names=["id", "tag1", "tag2", "start", "n"])

    def run(table: pa.Table) -> pa.Table:
        out = found(table)
        give_back()
        return out

    return run


def _compressed(rows):
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    for batch in (part for batch in rows for part in parts(batch, "_whole", PART_BYTES)):
        i = batch.schema.get_field_index("_whole")
        texts = batch.column(i).cast(pa.binary()).to_pylist()
        yield batch.set_column(i, "_whole", pa.array([None if x is None else compress(x) for x in texts], pa.binary()))


def _kept(k: int, joined: bool):
    """Task function: each text with its repeats to its remaining words."""

    def run(rows):
        import hashlib

        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        inside = space_class()
        for batch in (part for batch in rows for part in parts(batch, "_whole", PACKED_BYTES)):
            names = batch.schema.names
            found = batch.column(names.index("_found")).to_pylist()
            kept, n_words, n_removed, sha = [], [], [], []
            for z, spans_of in zip(batch.column(names.index("_whole")).to_pylist(), found):
                raw = expand(z) if z else b""
                data = np.frombuffer(raw, np.uint8)
                s, e, _ = spans(data, np.array([0, len(data)]), inside)
                stay = np.ones(len(s), bool)
                if spans_of:
                    edge = np.zeros(len(s) + 1, np.int32)
                    begin = np.array([x["start"] for x in spans_of])
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, np.minimum(begin + [x["n"] + k - 1 for x in spans_of], len(s)), -1)
                    stay = np.cumsum(edge[:-1]) == 0
                packed, _, pe = _packed(data, None, s[stay], e[stay])
                text = packed[:-1].tobytes() if len(packed) else b""
                n_words.append(len(s)), n_removed.append(int(len(s) - stay.sum()))
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(None if z is None else raw.decode() if stay.all() and not joined else text.decode())
            out = {n: batch.column(i) for i, n in enumerate(names) if n not in ("_whole", "_found")}
            out |= {"_kept": pa.array(kept, pa.string()), "_n_words": pa.array(n_words, pa.int64()), "_n_removed": pa.array(n_removed, pa.int64()), "_sha": pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return run


def dedup_substrings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 20, minimiser: int = 4, block_bytes: int = 8 << 20, joined: bool = True) -> DataFrame:
    """docs with `_kept` (its remaining words), `_n_words`, `_n_removed` and `_sha` (of the words joined by one space) beside its own columns.

    A window of so many consecutive words is repeated if the same words also start
    in a smaller document id, or earlier in the same document. Each word that a
    repeated window covers goes; windows are judged on the input.
    With joined False, a text that loses nothing keeps its white space.

    Null text: no words, kept null. Empty text: no words. Fewer words than a window:
    all stay. Null id: sorts first. Rows that repeat an id with one text count as one
    document; with different texts, 120 bits of the text's SHA-256 tell them apart and
    order them. An empty table gives
    an empty one. Own columns stay, whatever their names; one named as a new column gives way to it.
    """
    total = 3 * text_bytes(docs, text_column)
    n = buckets(docs.sparkSession, total, BUCKET_BYTES)
    own = own_fields(docs, [text_column, *KEPT])
    ident, text = column(id_column), column(text_column)
    key = F.coalesce(ident.cast("long"), F.lit(NO_ID))
    # where no id occurs twice, nothing needs telling apart
    shared = docs.groupBy(key.alias("id")).count().where("count > 1").limit(1).count() > 0
    digest = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    tags = [(F.conv(F.substring(digest, at, 15), 16, 10) if shared else F.lit(0)).cast("long").alias(f"tag{i}") for i, at in ((1, 1), (2, 16))]
    texts = docs.select(key.alias("id"), *tags, text.alias("text"))
    hot = docs.sparkSession.sparkContext.broadcast(hot_pieces(texts.select("text"), window, minimiser, total))
    found = (
        texts.mapInArrow(tidy(stretches(window, minimiser, n, block_bytes, hot)), STRETCH)
        .groupBy("bucket")
        .applyInArrow(repeats(window), REPEAT)
        .groupBy("id", "tag1", "tag2")
        .agg(F.collect_set(F.struct("start", "n")).alias("_found"))
    )
    keyed = docs.select(*[column(f.name).alias(f"own{i}") for i, f in enumerate(own)], key.alias("id"), *tags, text.alias("_whole"))
    packed = keyed.mapInArrow(tidy(_compressed), T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "_whole" else f.dataType) for f in keyed.schema.fields]))
    joined_rows = packed.join(found, ["id", "tag1", "tag2"], "left").drop("id", "tag1", "tag2")
    schema = T.StructType([T.StructField(f"own{i}", f.dataType) for i, f in enumerate(own)] + [T.StructField(n, t) for n, t in KEPT.items()])
    out = joined_rows.mapInArrow(tidy(_kept(window, joined)), schema)
    return out.select(*[F.col(f"own{i}").alias(f.name) for i, f in enumerate(own)], *KEPT)
