"""Line dedup: lines found in many documents go, by keep bitmaps instead of texts.

Documents lie in units, hash ranges of their ids. Each unit sends one row for
each distinct line: 128 bits of hash, in how many of its documents the line
stands, and the first of those places. The rows are range-partitioned by hash and
sorted by hash, document and position, so a line's rows stream past one after the
other, first occurrence first; as soon as a line's documents reach the threshold
its units are told. A unit turns what it hears into one compressed keep bitmap
for each document.

A line of a third of all documents is one row for each unit, never one for each
document.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import buckets, column, own_fields, text_bytes
from ._text import byte_values, give_back, hashes, mix, utf8

SPACE_BYTES = (0x20, *range(0x09, 0x0E))
UNIT_BYTES = 8 << 20
KEPT = "_kept string, _n_lines long, _n_dropped long, _bitmap binary, _sha string"
KEYS = "range int, h1 long, h2 long, unit int, docs long, first_id long, first_line long"


def _lines(column):
    """(data, starts, ends, owner, first line of each text) of the lines; every text has one at least."""
    data, offsets = utf8(column)
    breaks = np.flatnonzero(data == 10)
    n_texts = len(offsets) - 1
    per = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    bound = np.r_[0, np.cumsum(per)]
    starts, ends = np.zeros(bound[-1], np.int64), np.zeros(bound[-1], np.int64)
    lead, tail = np.zeros(bound[-1], bool), np.zeros(bound[-1], bool)
    if n_texts:
        lead[bound[:-1]], tail[bound[1:] - 1] = True, True
        starts[bound[:-1]], ends[bound[1:] - 1] = offsets[:-1], offsets[1:]
        starts[~lead], ends[~tail] = breaks + 1, breaks
    return data, starts, ends, np.repeat(np.arange(n_texts), per), bound


def _keys(data, starts, ends):
    """128 bits for each line's key, the line stripped and with A-Z in lower case; empty keys are (0, 0)."""
    space = np.zeros(256, bool)
    space[list(SPACE_BYTES)] = True
    solid = np.flatnonzero(~space[data])
    a = np.searchsorted(solid, starts)
    b = np.searchsorted(solid, ends)
    full = b > a
    s, e = starts.copy(), starts.copy()
    s[full], e[full] = solid[a[full]], solid[b[full] - 1] + 1
    values = byte_values(lower=True)
    h1 = hashes(data, s, e, values)
    h2 = hashes(data, s, e, mix(values))
    h1[~full], h2[~full] = 0, 0
    return h1, h2, full


def unit_keys(n_ranges: int):
    """Task function for one unit: a row for each distinct key."""

    def run(table: pa.Table) -> pa.Table:
        data, starts, ends, owner, bound = _lines(table.column("text"))
        h1, h2, full = _keys(data, starts, ends)
        at = np.flatnonzero(full)
        ids = table.column("id").combine_chunks().to_numpy(zero_copy_only=False)[owner[at]]
        order = at[np.lexsort((at, ids, h2[at], h1[at]))]
        h1, h2, who = h1[order], h2[order], owner[order]
        lead = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])][: len(order)]
        new = lead | np.r_[True, who[1:] != who[:-1]][: len(order)]
        begin = np.flatnonzero(lead)
        docs = np.add.reduceat(new.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)
        unit = table.column("unit")[0].as_py()
        h1, h2, first = h1[begin], h2[begin], order[begin]
        ids = table.column("id").combine_chunks().to_numpy(zero_copy_only=False)[owner[first]]
        part = ((h1 >> np.uint64(32)) * np.uint64(n_ranges)) >> np.uint64(32)
        return pa.table([pa.array(part.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(np.full(len(begin), unit, np.int32)), pa.array(docs), pa.array(ids), pa.array(first - bound[owner[first]])], names=["range", "h1", "h2", "unit", "docs", "first_id", "first_line"])

    return run


def common_keys(min_docs: int):
    """Task function over sorted rows: (unit, key) of the lines that enough documents have."""

    def run(rows):
        key, count, waiting, told = None, 0, [], False
        for batch in rows:
            out: list[tuple[int, int, int]] = []
            h1, h2, unit, docs = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("h1", "h2", "unit", "docs"))
            # only keys with several rows, or enough documents in one, need a closer look
            same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            look = np.r_[True, same] | np.r_[same, True] | (docs >= min_docs)
            if len(look):
                look[-1] = True
            for i in np.flatnonzero(look[: len(h1)]).tolist():
                now = (int(h1[i]), int(h2[i]))
                if now != key:
                    key, count, waiting, told = now, 0, [], False
                count += int(docs[i])
                if told:
                    out.append((int(unit[i]), *now))
                    continue
                waiting.append(int(unit[i]))
                if count >= min_docs:
                    out += [(u, *now) for u in waiting]
                    waiting, told = [], True
            if out:
                u, a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["unit", "h1", "h2"])

    return run


def unit_bitmaps(digests: bool, texts: bool):
    """Task function for one unit and its common keys: each row with its keep bitmap."""

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        import hashlib
        import zlib

        data, starts, ends, owner, bound = _lines(left.column("text"))
        h1, h2, full = _keys(data, starts, ends)
        gone = np.zeros(len(h1), bool)
        if right.num_rows:
            a, b = (right.column(n).combine_chunks().to_numpy().view(np.uint64) for n in ("h1", "h2"))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            for_each = np.searchsorted(a, h1)
            hit = full & (for_each < len(a))
            hit[hit] = a[for_each[hit]] == h1[hit]
            pairs = set(zip(a.tolist(), b.tolist()))
            at = np.flatnonzero(hit)
            gone[at] = [p in pairs for p in zip(h1[at].tolist(), h2[at].tolist())]
        n_lines = np.diff(bound)
        n_dropped = np.add.reduceat(gone.astype(np.int64), bound[:-1]) if len(n_lines) else n_lines
        bits, sha, kept = [], [], []
        view = memoryview(data)
        null = left.column("text").is_null().to_pylist()
        for d in range(len(n_lines)):
            lo, hi = bound[d], bound[d + 1]
            bits.append(zlib.compress(np.packbits(~gone[lo:hi]).tobytes()))
            if n_dropped[d]:
                text = b"\n".join([bytes(view[starts[i] : ends[i]]) for i in range(lo, hi) if not gone[i]])
            else:
                text = bytes(view[starts[lo] : ends[hi - 1]])
            sha.append(hashlib.sha256(text).hexdigest() if digests else None)
            kept.append(text.decode() if texts and not null[d] else None)
        out = {n: left.column(n) for n in left.column_names if n not in ("unit", "id", "text")}
        out |= {"_kept": pa.array(kept, pa.string()), "_n_lines": pa.array(n_lines, pa.int64()), "_n_dropped": pa.array(n_dropped, pa.int64()), "_bitmap": pa.array(bits, pa.binary()), "_sha": pa.array(sha, pa.string())}
        return pa.table(out)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = found(left, right)
        give_back()
        return out

    return run


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_docs: int = 10, digests: bool = True, texts: bool = True) -> DataFrame:
    """docs with `_bitmap` (zlib of one keep bit for each line), `_n_lines`, `_n_dropped`, `_kept` and `_sha` beside its own columns.

    A line's key is the line without ASCII white space at both ends and with A-Z in
    lower case. Lines whose key is not empty and stands in so many documents go from
    every document; the others stay, joined by a line feed.

    Null or empty text: one empty line, which stays. Null id: a document like any
    other. Each row is a document of its own, also if rows repeat an id or a text; a
    line twice in one document counts once. An empty table gives an empty one. Own
    columns stay, whatever their names; one named as a new column gives way to it.
    """
    spark = docs.sparkSession
    units = buckets(spark, text_bytes(docs, text_column), UNIT_BYTES)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = T.StructType.fromDDL(KEPT)
    own = own_fields(docs, [text_column, *made.names])
    ident, text = column(id_column), column(text_column)
    # a row's unit also depends on its text, so that repeated ids spread
    unit = F.pmod(F.xxhash64(ident, text), F.lit(units)).cast("int")
    rows = docs.select(*[column(f.name).alias(f"own{i}") for i, f in enumerate(own)], unit.alias("unit"), F.coalesce(ident.cast("long"), F.lit(-(2**63))).alias("id"), text.alias("text"))
    common = (
        rows.groupBy("unit")
        .applyInArrow(unit_keys(ranges), KEYS)
        .repartition(ranges, "range")
        .sortWithinPartitions("h1", "h2", "first_id", "first_line")
        .mapInArrow(common_keys(min_docs), "unit int, h1 long, h2 long")
    )
    kept = T.StructType([T.StructField(f"own{i}", f.dataType) for i, f in enumerate(own)] + made.fields)
    out = rows.groupBy("unit").cogroup(common.groupBy("unit")).applyInArrow(unit_bitmaps(digests, texts), kept)
    return out.select(*[F.col(f"own{i}").alias(f.name) for i, f in enumerate(own)], *made.names)
