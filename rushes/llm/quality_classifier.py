"""Quality classifier: a factorisation machine over hashed words, structure and size.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum is
half of (sum v_i x_i)^2 - sum (v_i x_i)^2 in each of the few factors, so scoring is
linear in a text's distinct words.

The model is fitted in one task on a bounded sample of labelled rows (`sample_rows`,
the rows with the smallest hash of their id); every row of the table is scored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import map_texts
from ._text import byte_values, hashes, mix, space_class, spans, utf8
from .quality_rules import _sums, repeated_words
from .packing import worker_cache

WORD_BITS = 15
STRUCTURE = 18


def features(column):
    """(bounds, indices, values) of the features of each text; structure comes before words."""
    inside = space_class()
    data, offsets = utf8(column)
    n = len(offsets) - 1
    s, e, bounds = spans(data, offsets, inside)
    lower = hashes(data, s, e, byte_values(lower=True))
    exact = hashes(data, s, e, byte_values())
    kinds = np.zeros((6, 256), bool)
    kinds[0, 65:91] = True  # capitals
    kinds[1, 48:58] = True  # digits
    kinds[2, [ord(c) for c in "#*$%&|<>"]] = True
    kinds[3, [ord(c) for c in ".,;:?"]] = True
    kinds[4, [ord(c) for c in "!"]] = True
    kinds[5, 10] = True
    size = np.diff(offsets)
    lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    chars = lead[offsets[1:]] - lead[offsets[:-1]]
    words = np.diff(bounds)
    owner = np.repeat(np.arange(n), words)
    length = (lead[e] - lead[s]).astype(float)
    some, any_ = np.maximum(words, 1), np.maximum(chars, 1)
    counts = [_sums(k[data], offsets) for k in kinds]
    mean = _sums(length, bounds) / some
    key = mix(lower ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    new = np.r_[True, key[order][1:] != key[order][:-1]][: len(order)]
    first = order[new]
    times = np.diff(np.flatnonzero(new), append=len(order))
    distinct = np.bincount(owner[first], minlength=n)
    biggest = np.zeros(n)
    np.maximum.at(biggest, owner[first], times)
    three = _sums(repeated_words(exact, bounds, 3), bounds) / some
    eight = _sums(repeated_words(exact, bounds, 8), bounds) / some
    short = _sums(length <= 3, bounds) / some
    table = np.stack(
        [
            *[np.sqrt(c / any_) for c in counts[:5]],
            np.minimum(counts[5] * 20 / some, 2),
            np.log1p(words) / 8,
            np.log1p(size) / 12,
            np.minimum(mean / 10, 3),
            distinct / some,
            biggest / some,
            three,
            eight,
            short,
            words < 20,
            counts[2] > 0.02 * any_,
            counts[0] > 0.3 * any_,
            chars == 0,
        ],
        axis=1,
    ).astype(np.float32)
    word_index = (lower[first] >> np.uint64(64 - WORD_BITS)).astype(np.int64) + STRUCTURE
    weight = np.log1p(times)
    norm = np.zeros(n)
    np.add.at(norm, owner[first], weight**2)
    weight = weight / np.sqrt(np.maximum(norm[owner[first]], 1e-9))
    rows = np.r_[np.repeat(np.arange(n), STRUCTURE), owner[first]]
    index = np.r_[np.tile(np.arange(STRUCTURE), n), word_index]
    value = np.r_[table.ravel(), weight].astype(np.float32)
    order = np.argsort(rows, kind="stable")
    return np.searchsorted(rows[order], np.arange(n + 1)), index[order], value[order]


class Machine:
    """The factorisation machine's parameters."""

    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.linear, self.factors = bias, linear, factors

    def raw(self, bounds, index, value):
        v = self.factors[index] * value[:, None]
        at = bounds[:-1]  # no row is empty: each has its structure features
        total, square = np.add.reduceat(v, at), np.add.reduceat(v * v, at)
        return self.bias + np.add.reduceat(self.linear[index] * value, at) + 0.5 * (total * total - square).sum(1), total

    def scores(self, bounds, index, value):
        if len(bounds) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(bounds, index, value)[0], -30, 30)))

    def to_bytes(self) -> bytes:
        return np.float32(self.bias).tobytes() + self.linear.astype("<f4").tobytes() + self.factors.astype("<f4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, rank: int) -> "Machine":
        x = np.frombuffer(raw, "<f4")
        n = (len(x) - 1) // (rank + 1)
        return cls(float(x[0]), x[1 : n + 1], x[n + 1 :].reshape(n, rank))


def fit(bounds, index, value, labels, rank: int, epochs: int, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss, in small batches; deterministic for given rows."""
    rng = np.random.default_rng(seed)
    size = STRUCTURE + (1 << WORD_BITS)
    share = np.clip(labels.mean(), 0.01, 0.99)
    model = Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), rng.normal(0, 0.05, (size, rank)).astype(np.float32))
    g_linear, g_factors, g_bias = np.full(size, 1e-3), np.full((size, rank), 1e-3), 1e-3
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 32)):
            sizes = np.diff(bounds)[rows]
            cut = np.r_[0, np.cumsum(sizes)]
            at = np.repeat(bounds[rows] - cut[:-1], sizes) + np.arange(cut[-1])
            i, x = index[at], value[at]
            raw, total = model.raw(cut, i, x)
            gap = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]) / len(rows)
            each = np.repeat(gap, sizes)
            v = model.factors[i]
            used, place = np.unique(i, return_inverse=True)
            d_linear = np.bincount(place, each * x, len(used)) + 1e-5 * model.linear[used]
            pull = each[:, None] * x[:, None] * (np.repeat(total, sizes, axis=0) - v * x[:, None])
            d_factors = np.stack([np.bincount(place, pull[:, f], len(used)) for f in range(rank)], 1) + 1e-5 * model.factors[used]
            g_linear[used] += d_linear**2
            g_factors[used] += d_factors**2
            g_bias += gap.sum() ** 2
            model.linear[used] -= 0.1 * d_linear / np.sqrt(g_linear[used])
            model.factors[used] -= 0.03 * d_factors / np.sqrt(g_factors[used])
            model.bias -= 0.05 * gap.sum() / np.sqrt(g_bias)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", folds: int = 5, held_fold: int = 0, sample_rows: int = 4000, rank: int = 4, epochs: int = 8) -> Machine:
    """Fits on at most sample_rows labelled rows outside the held-out fold (crc32 of the id as text, modulo folds).

    The parameters come to the driver; their size is fixed by WORD_BITS and rank.
    Rows without id, label or text are left out. Without any rows, or with one label
    alone, the machine gives that label's share, or one half.
    """
    key = F.col(f"`{id_column}`").cast("string")
    chosen = (
        labels.select(key.alias("_key"), F.col(f"`{label_column}`").cast("double").alias("_label"))
        .where(F.col("_key").isNotNull() & F.col("_label").isNotNull() & (F.crc32(F.col("_key").cast("binary")) % folds != held_fold))
        .orderBy(F.xxhash64("_key"), "_key", "_label")
        .limit(sample_rows)
    )
    rows = docs.select(key.alias("_key"), F.col(f"`{text_column}`").alias("_text")).join(F.broadcast(chosen), "_key").where(F.col("_text").isNotNull()).select("_key", "_text", "_label")
    size = STRUCTURE + (1 << WORD_BITS)

    def described(batches):
        for batch in batches:
            if batch.num_rows:
                bounds, index, value = features(batch.column(1))
                cut = lambda x, kind: pa.array([x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), cut(index, "<i8"), cut(value, "<f4"), batch.column(2)], names=["key", "index", "value", "label"])

    def trained(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["key"], r["label"], r["value"]))
        labels = np.array([r["label"] for r in rows])
        if len(set(labels.tolist())) < 2:
            share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
            model = Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), np.zeros((size, rank), np.float32))
        else:
            index = [np.frombuffer(r["index"], "<i8") for r in rows]
            model = fit(np.r_[0, np.cumsum([len(i) for i in index])], np.concatenate(index), np.concatenate([np.frombuffer(r["value"], "<f4") for r in rows]), labels, rank, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary())], names=["model"])

    model = rows.mapInArrow(described, "key string, index binary, value binary, label double").repartition(1).mapInArrow(trained, "model binary").first()
    return Machine.from_bytes(model["model"], rank)


def score_quality(docs: DataFrame, model: Machine, text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with `_score` (0 to 1) in place of the text, or beside it.

    The id, labels, language and source are no inputs. Null text is scored as the empty
    text is. Long texts are scored whole; ties and repeated rows get equal scores. An
    empty table gives an empty one. Own columns stay, whatever their names; one named `_score` gives way.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear, model.factors))

    def run(batches):
        worker_cache("quality_classifier")
        machine = Machine(*shared.value)
        for batch in batches:
            _, offsets = utf8(batch.column(batch.schema.get_field_index("_whole")))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (2 << 20), side="right")) - 1)
                part = batch.slice(a, b - a)
                out = {f: part.column(i) for i, f in enumerate(part.schema.names) if f != "_whole"}
                out["_score"] = pa.array(machine.scores(*features(part.column(part.schema.get_field_index("_whole")))).astype(float))
                yield pa.RecordBatch.from_pydict(out)
                a = b

    return map_texts(docs, text_column, run, "_score double", keep_text)
