"""LM scoring: a Katz backoff model with Good-Turing discounts, counted and applied by hash buckets.

    P(w | h) = d(c) c / T(h)      if h, w was seen c times in training
             = alpha(h) P(w)      else;   P(w) = (c(w) + 1) / (N + V + 1)

d are Good-Turing discounts of counts up to 5, alpha(h) = (1 - sum of the seen
words' discounted shares) / (1 - sum of their P(w)), so each P(. | h) sums to 1
exactly, with one unseen type. All words and all bigrams count.

Documents lie in units, runs of rows of one task. A unit sends its distinct words
and bigrams to hash buckets, sorted and packed, with the documents they stand in;
the tables of counts lie in the same buckets. A bucket answers a unit with one sum
for each document. So a frequent word or pair costs one entry for each unit.

Words with at least one in RARITY of the training tokens (so at most RARITY words)
have short codes, which every task knows. A bigram of two such words lies in the
bucket of its pair of codes. Any other lies in the bucket of a rare word of its own,
which can't be hot: of its second word if that is rare, else of its first. Where both
are rare, the second word's bucket sends P(w) to the first word's, and gets T and alpha.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import buckets, stored, text_bytes
from ._text import byte_values, hashes, mix, space_class, spans, utf8
from .packing import worker_cache

RARITY = 1 << 17
PAIR = np.uint64(1 << 18)
KEEP = 5
END = np.uint64(0xE5D0000000000001)
UNIT_BYTES = 6 << 20
SHORT = np.uint64((1 << 40) - 1)


def codec() -> tuple:
    """One compressor and one decompressor for each Python worker."""
    import zstandard

    cache = worker_cache("katz")
    if "zstd" not in cache:
        cache["zstd"] = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
    return cache["zstd"]


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    values = np.ascontiguousarray(values)
    return values.dtype.char.encode() + codec()[0](values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    kind = np.dtype(raw[:1].decode())
    planes = np.frombuffer(codec()[1](raw[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def narrow(values: np.ndarray) -> np.ndarray:
    most = int(values.max(initial=0))
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


class Units:
    """Runs of rows as units: tokens with the end after each text, and each token's text."""

    def __init__(self, rows):
        from pyspark import TaskContext

        context = TaskContext.get()
        self.base = (context.partitionId() if context else 0) << 24
        self.rows = rows

    def __iter__(self):
        inside, values = space_class(), byte_values(lower=True)
        serial = 0
        for batch in self.rows:
            names = batch.schema.names
            text = batch.column(names.index("text"))
            data, offsets = utf8(text)
            a = 0
            while a < len(text):
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + UNIT_BYTES, side="right")) - 1)
                part, bound = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                s, e, first = spans(part, bound, inside)
                n = np.diff(first) + 1
                ends = np.cumsum(n) - 1
                tokens = np.empty(int(n.sum()), np.uint64)
                word = np.ones(len(tokens), bool)
                word[ends] = False
                tokens[word] = hashes(part, s, e, values)
                tokens[~word] = END
                yield self.base + serial, {k: batch.column(names.index(k)).slice(a, b - a) for k in names if k != "text"}, tokens, np.repeat(np.arange(b - a), n), n
                serial += 1
                a = b


def by_bucket(keys: np.ndarray, n_buckets: int) -> list[tuple[int, np.ndarray]]:
    """Each bucket that has any of the keys, with their places in order; a bucket is a range of the mixed key."""
    bucket = ((mix(keys) >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    some, first = np.unique(bucket[order], return_index=True)
    return list(zip(some.tolist(), np.split(order, first[1:])))


def distinct(columns: list[np.ndarray], owner: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns (and of an ascending owner), sorted, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns + ([] if owner is None else [owner])]
    first = np.flatnonzero(changes(columns))
    return [c[first] for c in columns], np.diff(first, append=len(order))


def changes(columns: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def word_ids(tokens: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """1 + place in the sorted vocabulary, or 0."""
    if not len(vocabulary):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, tokens), len(vocabulary) - 1)
    return np.where(vocabulary[at] == tokens, at + 1, 0)


def contexts(ids: np.ndarray, owner: np.ndarray, start: int) -> np.ndarray:
    out = np.r_[0, ids[:-1]]
    out[np.r_[True, owner[1:] != owner[:-1]][: len(out)]] = start
    return out[: len(ids)]


def words_of(tokens: np.ndarray, owner: np.ndarray):
    """(kind, keys, others, owners) of a unit's words."""
    yield "word", [tokens], owner


def bigrams_of(tokens: np.ndarray, owner: np.ndarray, katz: dict):
    """(kind, [key, other], owners) of a unit's bigrams.

    coded: the pair of codes. mixed: the rare word, and the other's code times two, plus
    one if the other comes second. rare: the second word and the first.
    """
    ids = word_ids(tokens, katz["vocabulary"])
    before = contexts(ids, owner, katz["start"])
    last = np.r_[tokens[:1], tokens[:-1]]
    w, h = ids > 0, before > 0
    some = w & h
    yield "coded", [before[some].astype(np.uint64) * PAIR + ids[some].astype(np.uint64)], owner[some]
    some = w ^ h
    yield "mixed", [np.where(w, last, tokens)[some], np.where(w, ids * 2 + 1, before * 2)[some].astype(np.uint64)], owner[some]
    some = ~w & ~h
    yield "rare", [tokens[some], last[some]], owner[some]


COUNTED = "bucket int, kind string, keys binary, others binary, counts binary"
KINDS = ("word", "coded", "mixed", "rare")
PARTS = ("keys", "others", "counts")
TABLE = "bucket int, types long, tokens long, " + ", ".join(f"{k}_{p} binary" for k in KINDS for p in PARTS)


def counted(n_buckets: int, items):
    """Task function: each unit's distinct items and their counts, by bucket. items: tokens and owner to kinds of items."""

    def run(rows):
        for _, _, tokens, owner, _ in Units(rows):
            out = []
            for kind, columns, _ in items(tokens, owner):
                found, counts = distinct(columns)
                out += [(b, kind, pack_sorted(found[0][at]), pack(narrow(found[1][at])) if len(found) > 1 else None, pack(narrow(counts[at]))) for b, at in by_bucket(found[0], n_buckets)]
            types = (pa.int32(), pa.string(), *[pa.binary()] * 3)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[c.split()[0] for c in COUNTED.split(", ")])

    return run


def summed(units: pa.Table, known: pa.Table | None = None) -> pa.Table:
    """One bucket's items of all units, and its row so far, to one row of sorted items and total counts."""
    row: dict = known.to_pylist()[0] if known is not None and known.num_rows else {"types": 0, "tokens": 0}
    if not units.num_rows and known is not None:
        return known
    row["bucket"] = units.column("bucket")[0].as_py()
    for kind in KINDS:
        some = units.filter(pa.compute.equal(units.column("kind"), kind))
        if not some.num_rows:
            continue
        columns = [np.concatenate([unpack_sorted(x) for x in some.column("keys").to_pylist()])]
        if kind in ("mixed", "rare"):
            columns.append(np.concatenate([unpack(x).astype(np.uint64) for x in some.column("others").to_pylist()]))
        counts = np.concatenate([unpack(x).astype(np.int64) for x in some.column("counts").to_pylist()])
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        first = np.flatnonzero(changes(columns))
        counts = np.add.reduceat(counts[order], first)
        row[f"{kind}_keys"], row[f"{kind}_counts"] = pack_sorted(columns[0][first]), pack(narrow(counts))
        if len(columns) > 1:
            row[f"{kind}_others"] = pack(narrow(columns[1][first]))
        if kind == "word":
            row["types"], row["tokens"] = len(first), int(counts.sum())
    types = {"bucket": pa.int32(), "types": pa.int64(), "tokens": pa.int64()}
    names = [c.split()[0] for c in TABLE.split(", ")]
    return pa.table([pa.array([row.get(n)], types.get(n, pa.binary())) for n in names], names=names)


def items_of(row: dict, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, others and counts of one kind in a row of the table."""
    keys, others, counts = (row[f"{kind}_{p}"] for p in PARTS)
    return (
        np.zeros(0, np.uint64) if keys is None else unpack_sorted(keys),
        np.zeros(0, np.uint64) if others is None else unpack(others).astype(np.uint64),
        np.zeros(0, np.int64) if counts is None else unpack(counts).astype(np.int64),
    )


def discounts(times: np.ndarray, keep: int = KEEP) -> np.ndarray:
    """Factor of each count from 0 to keep; times[r] items occur r times.

    Good-Turing with Katz's renormalisation, for the largest number of discounted
    counts that gives factors over 0 and at most 1; if none does, half a count is taken off.
    """
    for k in range(keep, 0, -1):
        if (times[1 : k + 2] > 0).all():
            r = np.arange(1, k + 1)
            most = (k + 1) * times[k + 1] / times[1]
            ratio = (r + 1) * times[r + 1] / (r * times[r])
            d = (ratio - most) / (1 - most) if most < 1 else np.zeros(k)
            if ((d > 0) & (d <= 1)).all():
                return np.r_[1.0, d, np.ones(keep - k)]
    return np.r_[1.0, (np.arange(1, keep + 1) - 0.5) / np.arange(1, keep + 1)]


class Katz:
    """What every task needs of the model: bounded by RARITY. Counts of rare words and of bigrams stay in their buckets."""

    def __init__(self, vocabulary, counts, total, types, starts):
        self.vocabulary, self.total, self.types = vocabulary, total, types
        self.start = len(vocabulary) + 1
        self.counts = np.r_[0, counts, starts].astype(np.float64)
        self.share = np.r_[0, self.share_of(counts), 0]
        self.factors = np.ones(KEEP + 1)
        self.backoff = np.zeros(self.start + 1)
        self.total_of = np.maximum(self.counts, 1)

    @classmethod
    def of(cls, known: dict):
        katz = cls.__new__(cls)
        katz.__dict__.update(known)
        return katz

    def share_of(self, counts):
        return (counts + 1.0) / (self.total + self.types + 1)

    def discounted(self, counts):
        return counts * self.factors[np.where(counts <= KEEP, counts, 0)]

    def finish(self, times, context, by_count, more, seen_share):
        """times: bigrams by count; for each coded context, its bigrams of each count, the sum of larger counts, and the sum of P(w)."""
        self.factors = discounts(times)
        mass = by_count @ (self.factors[1:] * np.arange(1, KEEP + 1)) + more
        self.total_of[context], self.backoff[context] = weights_of(self.counts[context], mass, seen_share)


def weights_of(counts, mass, seen_share):
    """T(h) and log10 of alpha(h)."""
    total = np.where((mass > 0) & (mass >= counts * (1 - 1e-12)), counts + 1, counts)
    return total, np.log10((1 - mass / total) / (1 - seen_share))


def described(shared):
    """Task function: the table to sums of each coded context's bigrams; context 0 has those after rare words."""

    def run(batches):
        katz = Katz.of(shared.value)
        size = katz.start + 1
        sums = np.zeros((KEEP + 3, size))  # bounded by RARITY
        for batch in batches:
            for row in batch.to_pylist():
                words, _, word_counts = items_of(row, "word")
                coded, _, c0 = items_of(row, "coded")
                mixed, code, c1 = items_of(row, "mixed")
                _, _, c2 = items_of(row, "rare")
                second = code % 2 == 1
                h = np.r_[(coded // PAIR).astype(np.int64), np.where(second, 0, code // 2).astype(np.int64), np.zeros(len(c2), np.int64)]
                share = np.r_[katz.share[(coded % PAIR).astype(np.int64)], np.zeros(len(c1) + len(c2))]
                share[len(c0) : len(c0) + len(c1)][~second] = katz.share_of(word_counts[np.searchsorted(words, mixed[~second])])
                counts = np.r_[c0, c1, c2]
                for r in range(1, KEEP + 2):
                    sums[r - 1] += np.bincount(h[counts == r], minlength=size)
                sums[KEEP + 1] += np.bincount(h, np.where(counts > KEEP, counts, 0), size)
                sums[KEEP + 2] += np.bincount(h, share, size)
        context = np.flatnonzero(sums[: KEEP + 2].any(0))
        yield pa.RecordBatch.from_arrays([pa.array(context)] + [pa.array(c[context]) for c in sums], names=["context", *[f"c{i}" for i in range(len(sums))]])

    return run


LINKS = "bucket int, src int, contexts binary, counts binary, words binary"


def links(n_buckets: int):
    """Task function: each bucket's bigrams of two rare words to the buckets of their first words."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, _, word_counts = items_of(row, "word")
                keys, first, counts = items_of(row, "rare")
                of_word = word_counts[np.searchsorted(words, keys)]
                out = [(b, row["bucket"], pack(first[at]), pack(narrow(counts[at])), pack(narrow(of_word[at]))) for b, at in by_bucket(first, n_buckets)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), *[pa.binary()] * 3))], names=[c.split()[0] for c in LINKS.split(", ")])

    return run


WEIGHTS = "bucket int, src int, alpha binary, weight binary"


def weighed(shared):
    """Task function for one bucket: log10 alpha(h), and log10 T(h) alpha(h), of its rare words; and the latter for each link."""

    def run(met: pa.Table, tables: pa.Table) -> pa.Table:
        katz = Katz.of(shared.value)
        row = tables.to_pylist()[0]
        words, _, counts = items_of(row, "word")
        keys, code, c = items_of(row, "mixed")
        second = code % 2 == 1
        at = np.searchsorted(words, keys[second])
        # the sum of no rows has another type, so it is added to zeros
        mass = np.zeros(len(words)) + np.bincount(at, katz.discounted(c[second]), len(words))
        share = np.zeros(len(words)) + np.bincount(at, katz.share[(code[second] // 2).astype(np.int64)], len(words))
        linked = []
        for x in sorted(met.to_pylist(), key=lambda x: x["src"]):
            at = np.searchsorted(words, unpack(x["contexts"]))
            mass += np.bincount(at, katz.discounted(unpack(x["counts"]).astype(np.int64)), len(words))
            share += np.bincount(at, katz.share_of(unpack(x["words"]).astype(np.int64)), len(words))
            linked.append((x["src"], at))
        total, alpha = weights_of(counts.astype(np.float64), mass, share)
        weight = np.log10(total) + alpha
        own = row["bucket"]
        out = [(own, None, pack(alpha), pack(weight))] + [(src, own, None, pack(weight[at])) for src, at in linked]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "src", "alpha", "weight"])

    return run


def train_katz(docs: DataFrame, n_buckets: int, rarity: int = RARITY):
    """docs: train boolean, text. The model, its table of counts, and its weights of rare words."""
    spark = docs.sparkSession
    training = docs.where("train")
    unigrams = stored(training.mapInArrow(counted(n_buckets, words_of), COUNTED).groupBy("bucket").applyInArrow(lambda units: summed(units), TABLE))
    sums = unigrams.agg(F.sum("types"), F.sum("tokens")).first()
    types, total = sums[0] or 0, sums[1] or 0

    def frequent(batches):
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, counts = unpack_sorted(keys), unpack(counts).astype(np.int64)
                many = counts * rarity >= total
                yield pa.RecordBatch.from_arrays([pa.array([keys[many].tobytes()], pa.binary()), pa.array([counts[many].tobytes()], pa.binary())], names=["keys", "counts"])

    rows = unigrams.select("word_keys", "word_counts").mapInArrow(frequent, "keys binary, counts binary").collect()
    vocabulary = np.concatenate([np.zeros(0, np.uint64)] + [np.frombuffer(r["keys"], np.uint64) for r in rows])
    counts = np.concatenate([np.zeros(0, np.int64)] + [np.frombuffer(r["counts"], np.int64) for r in rows])
    order = np.argsort(vocabulary)
    model = Katz(vocabulary[order], counts[order], total, types, training.count())
    codes = spark.sparkContext.broadcast(model.__dict__)
    bigrams = training.mapInArrow(counted(n_buckets, lambda tokens, owner: bigrams_of(tokens, owner, codes.value)), COUNTED)
    table = stored(bigrams.groupBy("bucket").cogroup(unigrams.groupBy("bucket")).applyInArrow(lambda units, known: summed(units, known), TABLE))

    names = [f"c{i}" for i in range(KEEP + 3)]
    # at most one row for each coded word
    stats = table.mapInArrow(described(codes), "context long, " + ", ".join(f"{n} double" for n in names)).groupBy("context").agg(*[F.sum(n).alias(n) for n in names]).orderBy("context").toPandas()
    grid, context = stats[names].to_numpy(), stats["context"].to_numpy()
    coded = context > 0
    model.finish(np.r_[0, grid[:, : KEEP + 1].sum(0)], context[coded], grid[coded, :KEEP], grid[coded, KEEP + 1], grid[coded, KEEP + 2])
    shared = spark.sparkContext.broadcast(model.__dict__)
    columns = {k: [f"{k}_{p}" for p in PARTS] for k in KINDS}
    met = table.select("bucket", *columns["word"], *columns["rare"]).mapInArrow(links(n_buckets), LINKS)
    weights = met.groupBy("bucket").cogroup(table.select("bucket", *columns["word"], *columns["mixed"]).groupBy("bucket")).applyInArrow(weighed(shared), WEIGHTS)
    return model, shared, table, weights


ASK = "bucket int, unit long, texts int, kind string, keys binary, others binary, sizes binary, at binary, n binary, held binary"


def questions(n_buckets: int, shared):
    """Task function: each unit's distinct words and bigrams with the texts they stand in, by bucket; and one row of its texts.

    The rare word of a bigram is told by its place among the unit's words in that bucket, the other rare word by 40 bits.
    """

    def places(columns, owner):
        (*items, text), n = distinct(columns, owner)
        begin = np.r_[np.flatnonzero(changes(items)), len(n)]
        for b, w in by_bucket(items[0][begin[:-1]], n_buckets):
            sizes = begin[w + 1] - begin[w]
            at = np.repeat(begin[w] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            others = pack(narrow(items[1][begin[w]] & SHORT)) if len(items) > 1 else None
            yield b, items[0][begin[w]], (others, pack(narrow(sizes)), pack(narrow(text[at])), pack(narrow(n[at])))

    def run(rows):
        import pickle

        katz = shared.value
        for unit, own, tokens, owner, n in Units(rows):
            before = contexts(word_ids(tokens, katz["vocabulary"]), owner, katz["start"])
            backoff = np.bincount(owner, katz["backoff"][before], len(n))
            out, words = [], {}
            for kind, columns, owners in [*words_of(tokens, owner), *bigrams_of(tokens, owner, katz)]:
                for b, keys, found in places(columns, owners):
                    if kind == "word":
                        words[b] = keys
                    elif kind != "coded":
                        keys = np.searchsorted(words[b], keys).astype(np.uint64)
                    out.append((b, unit, len(n), kind, pack_sorted(keys), *found, None))
            held = pickle.dumps(({k: v.to_pylist() for k, v in own.items()}, n, backoff))
            out.append((unit % n_buckets, unit, len(n), *[None] * 6, held))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.string(), *[pa.binary()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[c.split()[0] for c in ASK.split(", ")])

    return run


ANSWER = "unit long, bucket int, at binary, base binary, known binary, gain binary, held binary"


def paired(keys: np.ndarray, others: np.ndarray | None) -> np.ndarray:
    return keys if others is None or not len(others) else mix(keys ^ mix((others & SHORT) + np.uint64(1)))


def valued(katz: Katz, rows: list[dict], n_buckets: int) -> dict:
    """One bucket's rows of table and weights: for each kind, sorted keys and their values."""
    row = next((r for r in rows if r["types"] is not None), None)
    if row is None:
        return {}
    own = next(r for r in rows if r["weight"] is not None and r["src"] is None)
    alpha, weight = unpack(own["alpha"]), unpack(own["weight"])
    replies = {r["src"]: r["weight"] for r in rows if r["src"] is not None}
    words, _, counts = items_of(row, "word")
    share = katz.share_of(counts)
    out = {"word": (words, np.log10(counts + 1.0), alpha)}

    keys, _, c = items_of(row, "coded")
    h, w = (keys // PAIR).astype(np.int64), (keys % PAIR).astype(np.int64)
    out["coded"] = keys, np.log10(katz.discounted(c)) - np.log10(katz.total_of[h]) - katz.backoff[h] - np.log10(katz.share[w])

    keys, others, c = items_of(row, "mixed")
    code, second, at = (others // 2).astype(np.int64), others % 2 == 1, np.searchsorted(words, keys)
    gain = np.log10(katz.discounted(c))
    gain[second] -= weight[at[second]] + np.log10(katz.share[code[second]])
    gain[~second] -= np.log10(katz.total_of[code[~second]]) + katz.backoff[code[~second]] + np.log10(share[at[~second]])
    out["mixed"] = paired(keys, others), gain

    keys, others, c = items_of(row, "rare")
    gain = np.log10(katz.discounted(c)) - np.log10(share[np.searchsorted(words, keys)])
    for b, at in by_bucket(others, n_buckets):
        gain[at] -= unpack(replies[b])
    out["rare"] = paired(keys, others), gain
    for kind in ("mixed", "rare"):
        keys, gain = out[kind]
        order = np.argsort(keys)
        out[kind] = keys[order], gain[order]
    return out


def answers(shared, n_buckets: int):
    """Task function for one bucket: questions and its part of the tables to each unit's sums."""

    def run(asked: pa.Table, tables: pa.Table) -> pa.Table:
        known = valued(Katz.of(shared.value), tables.to_pylist(), n_buckets)
        out = []

        def sums(rows):
            """base, known and gain of the texts of one unit."""
            total, touched = np.zeros((3, rows[0]["texts"])), np.zeros(rows[0]["texts"], bool)
            words = next((unpack_sorted(r["keys"]) for r in rows if r["kind"] == "word"), None)
            for row in rows:
                kind = row["kind"]
                keys = unpack_sorted(row["keys"])
                if kind in ("mixed", "rare"):
                    keys = words[keys.astype(np.int64)]
                items = paired(keys, None if row["others"] is None else unpack(row["others"]).astype(np.uint64))
                sizes, text, n = (unpack(row[c]).astype(np.int64) for c in ("sizes", "at", "n"))
                if kind not in known or not len(known[kind][0]):
                    continue
                table, *values = known[kind]
                at = np.minimum(np.searchsorted(table, items), len(table) - 1)
                hit = table[at] == items
                touched[text] = True
                into = (0, 2) if kind == "word" else (2,)
                for i, v in zip(into, values):
                    total[i] += np.bincount(text, np.repeat(np.where(hit, v[at], 0), sizes) * n, len(touched))
                if kind == "word":
                    total[1] += np.bincount(text, np.repeat(hit, sizes) * n, len(touched))
            at = np.flatnonzero(touched)
            if len(at):
                out.append((rows[0]["unit"], rows[0]["bucket"], pack_sorted(at.astype(np.uint64)), total[0, at].tobytes(), pack(narrow(total[1, at].astype(np.int64))), total[2, at].tobytes(), None))

        rows: list[dict] = []
        for batch in asked.sort_by([("unit", "ascending"), ("kind", "ascending")]).to_batches(max_chunksize=16):
            for row in batch.to_pylist():
                if row["held"] is not None:
                    out.append((row["unit"], row["bucket"], None, None, None, None, row["held"]))
                    continue
                if rows and rows[0]["unit"] != row["unit"]:
                    sums(rows)
                    rows = []
                rows.append(row)
        if rows:
            sums(rows)
        types, names = (pa.int64(), pa.int32(), *[pa.binary()] * 5), [c.split()[0] for c in ANSWER.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)

    return run


def totals(total: int, types: int, names: list[str]):
    """Task function for one unit: its sums to a row for each text."""

    def run(table: pa.Table) -> pa.Table:
        import pickle

        rows = table.to_pylist()
        own, n, backoff = pickle.loads(next(r["held"] for r in rows if r["held"] is not None))
        base, known, gain = np.zeros(len(n)), np.zeros(len(n), np.int64), np.zeros(len(n))
        for r in sorted((r for r in rows if r["held"] is None), key=lambda r: r["bucket"]):
            at = unpack_sorted(r["at"]).astype(np.int64)
            base[at] += np.frombuffer(r["base"])
            known[at] += unpack(r["known"]).astype(np.int64)
            gain[at] += np.frombuffer(r["gain"])
        base -= n * np.log10(total + types + 1.0)
        out = {c: pa.array(own[c], pa.int64() if c == "doc_id" else pa.bool_()) for c in names}
        return pa.table(out | {"_n_tokens": pa.array(n), "_n_known": pa.array(known), "_train_tokens": pa.array(np.full(len(n), total)), "_base_score": pa.array(base), "_score": pa.array(base + backoff + gain)})

    return run


def score_katz(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folds: int = 7, held_fold: int = 2, rarity: int = RARITY) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Tokens are words without ASCII white space, A-Z in lower case, then one end. Rows
    whose crc32 of the id as text, modulo folds, is held_fold are held out of training.
    rarity (at most RARITY) says which words have codes; it does not change the scores.

    Null or empty text: the end alone. Null id: not held out. Rows that repeat an id or
    a text count, and are scored, once each. Long texts are scored whole. An empty table
    gives an empty one. Other columns are not read.
    """
    n = buckets(docs.sparkSession, text_bytes(docs, text_column), 32 << 20)
    ident = F.col(f"`{id_column}`")
    held = F.coalesce(F.crc32(ident.cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    rows = docs.select(ident.cast("long").alias("doc_id"), (~held).alias("train"), F.col(f"`{text_column}`").alias("text"))
    model, shared, table, weights = train_katz(rows, n, rarity)
    tables = table.unionByName(weights, allowMissingColumns=True)
    asked = rows.mapInArrow(questions(n, shared), ASK)
    answered = asked.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(answers(shared, n), ANSWER)
    out = answered.groupBy("unit").applyInArrow(totals(model.total, model.types, ["doc_id", "train"]), "doc_id long, train boolean, _n_tokens long, _n_known long, _train_tokens long, _base_score double, _score double")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), F.col("_n_tokens").alias("n_tokens"), F.col("_n_known").alias("n_known"), F.col("_train_tokens").alias("train_tokens"), F.col("_base_score").alias("base_score"), F.col("_score").alias("score"))
