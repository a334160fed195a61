"""Exact top-k search by inner product with multi-resolution segment statistics.

Cut into segments, two vectors x and q have in each segment of n components with
means m and deviations s a squared distance of at least n ((m_x - m_q)^2 + (s_x -
s_q)^2). So |x|^2 + |q|^2 less that bound is at least twice the inner product; as
n (m^2 + s^2) adds up to |x|^2, the inner product is at most the sum of n (m_x m_q +
s_x s_q). The bound is taken coarse first, for groups of rows of like means by the
range of their statistics; groups that can still enter a query's best k go on to finer
segments, and the survivors' inner products are computed exactly: row by row where few
survive, as one product of matrices where most do.

Queries and candidates lie in packed blocks, dealt to cells: each group of queries meets
each group of candidates in one task, which takes a block of queries through all of its
candidates and keeps the best k of each query so far as what the next must reach.

Vectors of large components lie in blocks of their own. Where doubles do not hold all
sums exactly, the bound is each rounded product with its error instead, and the
survivors' products are integers of 64 bits or, where these could overflow, of any size.
"""

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "dim int, width int, ids binary, vectors binary"
#: Rows whose statistics are bounded together; rows compared at once; the share of groups up to which survivors go row by row.
GROUP, TILE, FEW = 16, 4096, 0.01
#: So many times k rows give a first floor.
START = 64
LEVELS = (1, 4, 16)
FOUND = ["query_id", "vec_id", "score", "side", "key"]
#: Components of the candidates and of the queries of a cell.
CELL, ASKED = 1 << 23, 1 << 22


def _width(top: float) -> int:
    """Bytes for components up to top in size; more than 8 in steps, so that few kinds of blocks arise."""
    if top < 2.0**15:
        return 2
    if top <= 2.0**22:
        return 4
    return 8 if top < 2.0**62 else -(-(int(top).bit_length() + 2) // 128) * 16


def _floors(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as integers of any size, also where the product is no double."""
    return np.array([int(np.floor(x * scale)) if np.isfinite(x * scale) else Fraction(x) * Fraction(scale) // 1 for x in values.tolist()], object)


def _packed(x: np.ndarray, width: int) -> bytes:
    if width <= 8:
        return x.astype(f"<i{width}").tobytes()
    return b"".join(int(v).to_bytes(width, "little", signed=True) for v in x.ravel())


def _unpacked(data: bytes, width: int, dim: int) -> np.ndarray:
    if width <= 8:
        return np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(-1, dim)
    return np.array([int.from_bytes(data[a : a + width], "little", signed=True) for a in range(0, len(data), width)], object).reshape(-1, dim)


def _quantised(rows, scale: float):
    """(dimension, width, ids, integer matrix) of the usable vectors of Arrow batches."""
    for batch in rows:
        column = batch.column(batch.schema.get_field_index("vector"))
        ids = batch.column(batch.schema.get_field_index("id"))
        usable = ids.is_valid().to_numpy(zero_copy_only=False) & column.is_valid().to_numpy(zero_copy_only=False)
        cuts, components = column.offsets.to_numpy().astype(np.int64), column.values
        size = np.diff(cuts)
        values = components.to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes nan
        ids = ids.fill_null(0).to_numpy()
        for dim in np.unique(size[usable & (size > 0)]).tolist():
            at = np.flatnonzero(usable & (size == dim))
            whole = values[cuts[at][:, None] + np.arange(dim)]
            finite = np.isfinite(whole).all(1)
            at, whole = at[finite], whole[finite]
            with np.errstate(over="ignore"):
                x = np.floor(whole * scale)
            top = np.abs(x).max(1)
            large = top >= 2.0**62
            by: dict[int, list[int]] = {}
            for k in np.flatnonzero(~large & (top > 2.0**22)).tolist():
                by.setdefault(_width(top[k]), []).append(k)
            for width, some in ((2, top < 2.0**15), (4, (top >= 2.0**15) & (top <= 2.0**22)), *by.items()):
                if x[some].size:
                    yield dim, width, ids[at[some]], x[some].astype(np.int64)
            for k in np.flatnonzero(large).tolist():
                exact = _floors(whole[k], scale)
                yield dim, _width(max(map(abs, exact))), ids[at[k : k + 1]], exact[None]


def packed_blocks(scale: float, size: int, keep=None):
    """Task function: vectors to blocks of at most so many rows, cut where the rows lie."""

    def run(rows):
        wait: dict[tuple[int, int], list] = {}

        def emit(dim, width, parts):
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            for a in range(0, len(ids), size):
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([width], pa.int32()), pa.array([ids[a : a + size].tobytes()], pa.binary()), pa.array([_packed(x[a : a + size], width)], pa.binary())], names=["dim", "width", "ids", "vectors"])

        for dim, width, ids, x in _quantised(rows, scale):
            if keep is not None:
                chosen = ids % keep == 0
                ids, x = ids[chosen], x[chosen]
            if len(ids):
                kind = dim, width
                wait.setdefault(kind, []).append((ids, x))
                if sum(len(p[0]) for p in wait[kind]) >= size:
                    yield from emit(*kind, wait.pop(kind))
        for kind, parts in wait.items():
            yield from emit(*kind, parts)

    return run


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """sqrt(n) times the mean and deviation of each segment of each row."""
    edges = np.linspace(0, x.shape[1], segments + 1).round().astype(int)
    edges = np.unique(edges)
    n = np.diff(edges)
    total = np.add.reduceat(x, edges[:-1], axis=1)
    square = np.add.reduceat(x * x, edges[:-1], axis=1)
    mean = total / n
    return mean * np.sqrt(n), np.sqrt(np.maximum(square / n - mean**2, 0)) * np.sqrt(n)


class Block:
    """Vectors with their ids and statistics; values are doubles, or single floats where these hold them."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.top, self.ids, self.wide = int(abs(x).max()), ids, x
        self.values, self.stats = None, {}
        if self.top < 2**53:
            values = x.astype(np.float64)
            self.norm = np.sqrt((values * values).sum(1))
            self.stats = {s: segment_statistics(values, s) for s in LEVELS if s <= x.shape[1]}
            self.values, self.wide = values.astype(np.float32) if self.top < 2**24 else values, None

    def exact(self) -> np.ndarray:
        return self.values.astype(np.int64) if self.wide is None else self.wide


class Queries(Block):
    """A block of queries and the best k rows of each so far; floor is what the next must reach."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int):
        super().__init__(x, ids)
        self.k, self.floor = k, np.full(len(ids), -np.inf)
        self.at, self.found, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, at, found, score):
        """Further rows: the best k of each query stay, ties to the smaller id."""
        self.at, self.found, self.score = np.r_[self.at, at], np.r_[self.found, found], np.r_[self.score, score]
        order = np.lexsort((self.found, -self.score, self.at))
        place = self.at[order]
        first = np.searchsorted(place, np.arange(len(self.ids)))
        order = order[np.arange(len(order)) - first[place] < self.k]
        self.at, self.found, self.score = self.at[order], self.found[order], self.score[order]
        full = np.flatnonzero(np.bincount(self.at, minlength=len(self.ids)) == self.k)
        last = self.score[np.searchsorted(self.at, full, side="right") - 1]
        # beyond the doubles' whole numbers the floor is near enough: only products that they hold are compared with it
        self.floor[full] = last if last.dtype != object else [float(min(max(v, -(2**1000)), 2**1000)) for v in last]


class Rows(Block):
    """Candidates in the order of their means, with the ranges of the statistics of each GROUP of them."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        order = np.argsort(x.sum(1), kind="stable")
        super().__init__(x[order], ids[order])
        begin = np.arange(0, len(ids), GROUP)
        self.ranges = {s: (np.maximum.reduceat(m, begin), np.minimum.reduceat(m, begin), np.maximum.reduceat(d, begin)) for s, (m, d) in self.stats.items()}


def meet(q: Queries, x: Rows):
    """The rows of x that enter a query's best k."""
    n, dim = len(x.ids), (x.wide if x.values is None else x.values).shape[1]
    most = max(q.top * x.top, q.top**2, x.top**2) * dim
    if most > 2**53:
        at, found, score = _best_of_wide(q.exact(), q.ids, x.exact(), x.ids, q.k, most)
        q.add(at, found, np.array(score, object if most >= 2**63 else np.int64))
        return
    # single floats where they hold all sums exactly
    kind = np.float32 if most < 2**24 else np.float64
    q_values, x_values = q.values.astype(kind, copy=False), x.values.astype(kind, copy=False)

    def enter(i, j, score):
        some = x.ids[j] != q.ids[i]
        if some.any():
            q.add(i[some], x.ids[j[some]], score[some].astype(np.int64))

    if (q.floor == -np.inf).any() and n > START * q.k:
        # a start: what k of some rows reach, the query's own id left out
        some = np.linspace(0, n - 1, START * q.k + 1).astype(int)
        score = (q_values @ x_values[some].T).astype(np.float64)
        score[q.ids[:, None] == x.ids[some][None, :]] = -np.inf
        q.floor = np.maximum(q.floor, np.partition(score, -q.k, axis=1)[:, -q.k])
    # one unit and a share more than the bounds, for rounding
    reach = q.floor - 1 - 1e-9 * q.norm * x.norm.max()
    alive = np.ones((len(q.ids), -(-n // GROUP)), bool)
    for s, (m, d) in q.stats.items():
        alive &= np.hstack((np.maximum(m, 0), np.minimum(m, 0), d)) @ np.hstack(x.ranges[s]).T >= reach[:, None]
        if not alive.any():
            return
    if alive.mean() > FEW:
        at, columns = np.flatnonzero(alive.any(1)), np.flatnonzero(np.repeat(alive.any(0), GROUP)[:n])
        score = (q_values if len(at) == len(q.ids) else q_values[at]) @ (x_values if len(columns) == n else x_values[columns]).T
        i, j = np.divmod(np.flatnonzero(score >= q.floor[at].astype(kind)[:, None]), len(columns))
        enter(at[i], columns[j], score[i, j])
        return
    at, group = np.nonzero(alive)
    for a in range(0, len(at), TILE):
        i = np.repeat(at[a : a + TILE], GROUP)
        j = (group[a : a + TILE, None] * GROUP + np.arange(GROUP)).ravel()
        i, j = i[j < n], j[j < n]
        for s, (m, d) in q.stats.items():
            some = (m[i] * x.stats[s][0][j]).sum(1) + (d[i] * x.stats[s][1][j]).sum(1) >= reach[i]
            i, j = i[some], j[some]
        score = (q_values[i].astype(np.float64) * x_values[j]).sum(1)
        some = score >= q.floor[i]
        enter(i[some], j[some], score[some])


def _best_of_wide(queries, query_ids, rows, row_ids, k: int, most: int):
    """The same where sums can exceed what doubles hold exactly; no sum exceeds most."""
    if most >= 2**63:
        exact_q, exact_x = queries.astype(object), rows.astype(object)
    else:
        exact_q, exact_x = queries, rows
    dim = rows.shape[1]
    # a square beyond the doubles leaves no bound: then all products are exact
    bounded = max(int(abs(queries).max()), int(abs(rows).max())) ** 2 * dim < 2**1000
    if bounded:
        q, x = queries.astype(np.float64), rows.astype(np.float64)
        near = q @ x.T
        # twice the error of a sum of rounded products of rounded factors, in any order
        wrong = (dim + 16) * 2.0**-52 * np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))
    out_q, out_i, out_s = [], [], []
    for j in range(len(queries)):
        alive = np.flatnonzero(row_ids != query_ids[j])
        if bounded and len(alive) > k:
            floor = np.partition((near[j] - wrong[j])[alive], -k)[-k]
            alive = alive[(near[j] + wrong[j])[alive] >= floor]
        score = (exact_x[alive] @ exact_q[j]).tolist()
        best = sorted(zip((-s for s in score), row_ids[alive].tolist()))[:k]
        out_q += [j] * len(best)
        out_i += [i for _, i in best]
        out_s += [-s for s, _ in best]
    return np.array(out_q, np.int64), np.array(out_i, np.int64), out_s


def _beyond(score: int):
    """(side, key) that order scores which no bigint holds: by side, then by key as bytes."""
    if -(2**63) <= score < 2**63:
        return 0, None
    data = abs(score).to_bytes((score.bit_length() + 7) // 8, "big")
    key = len(data).to_bytes(4, "big") + data
    return (1, key) if score > 0 else (-1, bytes(255 - b for b in key))


def _tiles(table: pa.Table, size: int):
    """(ids, integer matrix) of a cell's blocks, put together to so many rows of one width."""
    wait: dict[int, list] = {}

    def joined(parts):
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    for r in (r for batch in table.to_batches() for r in batch.to_pylist()):
        ids, x = np.frombuffer(r["ids"], np.int64), _unpacked(r["vectors"], r["width"], r["dim"])
        held = wait.setdefault(r["width"], [])
        if held and sum(len(p[0]) for p in held) + len(ids) > size:
            yield joined(held)
            held.clear()
        held.append((ids, x))
    yield from (joined(held) for held in wait.values() if held)


def search_top_k(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, query_every: int = 50, scale: float = 256.0, query_block: int = 512, row_block: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k largest inner products with other rows.

    Components become floor(scale * x). Queries are the rows whose id is divisible by
    query_every; candidates are all rows but the query's own id. Ties go to the smaller id.

    Rows with a null id, vectors that are null or empty or hold a null or non-finite
    component take no part. Finite components of any size do, and are compared exactly;
    a score that no bigint holds is null, its rank and vec_id are right. Vectors are compared with those of their own length. Rows
    that repeat an id are candidates once each; a query that repeats is answered once.
    An empty table gives an empty one. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").alias("vector"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    is_query = F.col("id") % query_every == 0
    size = F.greatest(F.size("vector"), F.lit(0)).cast("long")
    every, asking = rows.agg(F.sum(size), F.sum(F.when(is_query, size))).first()
    # cells of so many groups of queries by so many of candidates: neither grows with the table
    asked_groups, groups = max(1, -(-(asking or 0) // ASKED)), max(parts, -(-(every or 0) // CELL))
    deal = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.where(is_query).dropDuplicates(["id"]).coalesce(8).mapInArrow(packed_blocks(scale, query_block), BLOCK).select("*", deal(asked_groups).alias("asked"), all_of(groups).alias("part"))
    blocks = rows.mapInArrow(packed_blocks(scale, row_block), BLOCK).select("*", deal(groups).alias("part"), all_of(asked_groups).alias("asked"))

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        if left.num_rows and right.num_rows:
            tiles = [Rows(x, ids) for ids, x in _tiles(left, TILE)]
            for ids, x in _tiles(right, query_block):
                queries = Queries(x, ids, k)
                for tile in tiles:
                    meet(queries, tile)
                score = queries.score.tolist()
                side, key = zip(*map(_beyond, score)) if score else ((), ())
                fits = [None if s else v for s, v in zip(side, score)]
                made.append(pa.table([pa.array(ids[queries.at]), pa.array(queries.found), pa.array(fits, pa.int64()), pa.array(side, pa.int32()), pa.array(key, pa.binary())], names=FOUND))
        return pa.concat_tables(made) if made else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())], names=FOUND)

    cell = ["dim", "asked", "part"]
    best = blocks.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(compared, "query_id long, vec_id long, score long, side int, key binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("key"), F.desc("score"), F.asc("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
