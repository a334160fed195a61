"""Cross-tokenizer alignment: merge-path partitioning of two tokenizers' token ends.

A text's tokens by A and by B cut the same bytes, so what overlaps follows from
merging two sorted lists of ends. Ends of many documents in a row are merged as one
pair of lists. Diagonal binary searches divide that merge into pieces of equal
work, whatever the documents' lengths; each piece emits its overlaps knowing one
end before it, and groups that go over a piece's border are stitched by running
counts of the ends common to both lists.

Documents are encoded once, in units of some megabytes, cut at spaces where both
tokenizers cut; a worker keeps both encodings of the words it met. A unit keeps its distinct
pairs of ids with their counts and each link as a place among those pairs, packed.
Counts are added up by Spark; pairs with at least one in 2^17 of all links, at most
2^17 of them, are told to all tasks, and only links of rarer pairs are shuffled to
the counts, added up by document and pair.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._backtrack import Backtracker, packed_words
from ._spark import column, own_fields, stored
from ._text import give_back, parts, tidy
from .bpe import Bpe
from .packing import Recent, ranges, worker_cache
from .piece_bpe import CACHED_CHARS, SPACE, PieceBpe, read_model

#: Elements of both lists that one piece of the merge path has.
WORK = 1 << 16
UNIT_BYTES = 3 << 19
#: Set in the ids of B where those of a word stand behind its ids of A.
OF_B = 1 << 31
#: Pairs with at least one in so many links are told to all tasks.
FREQUENT = 1 << 17
COUNTS = "_n_a long, _n_b long, _n_groups long, _n_links long, _groups_sha256 string"
#: Of a unit row: A ids, B ids and counts of its distinct pairs, frequent ones first; places of its links among them; its documents' keys and numbers of links.
UNIT = "pairs array<long>, counts array<int>, links binary, keys binary, sizes binary"


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two sorted lists crosses every work-th diagonal: elements of a and of b before it. Of equal values a's comes first."""
    total = len(a) + len(b)
    d = np.append(np.arange(0, total, work), total)
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        before = a[mid] <= b[d[open_] - 1 - mid]
        low[open_] = np.where(before, mid + 1, low[open_])
        high[open_] = np.where(before, high[open_], mid)
    return low, d - low


def merge_piece(a: np.ndarray, b: np.ndarray, a0: int, a1: int, b0: int, b1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One piece of the path: its overlaps as indices into a and b, in order, and which of a[a0:a1] end where a token of b does."""
    in_a, in_b = a[a0:a1], b[b0:b1]
    left = b0 + np.searchsorted(in_b, in_a, side="left")
    common = left < len(b)
    common[common] = b[left[common]] == in_a[common]
    right = a0 + np.searchsorted(in_a, in_b, side="right")
    # an end of b that a has too stands behind it on the path; it may be the first of the next piece
    new = right == 0
    new |= a[right - 1] != in_b if len(a) else True
    i = np.r_[np.arange(a0, a1), right[new]]
    j = np.r_[left, np.arange(b0, b1)[new]]
    order = np.argsort(i + j, kind="stable")
    return i[order], j[order], common


def align(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(links into a, links into b, group of each token of a, group of each token of b) of two lists of rising ends with the same last end."""
    at, bt = diagonals(a, b, work)
    pieces = [merge_piece(a, b, at[k], at[k + 1], bt[k], bt[k + 1]) for k in range(len(at) - 1)]
    if not pieces:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    i, j, common = (np.concatenate([p[k] for p in pieces]) for k in range(3))
    # stitching: a token's group is the number of common ends before it
    before = np.cumsum(common)
    cut = a[common]
    return i, j, before - common, np.searchsorted(cut, b, side="left")


class Coders:
    """Both tokenizers, with the bytes of their tokens as texts mean them."""

    def __init__(self, a_content: str, b_content: bytes):
        import re

        self.a, self.b = Bpe(a_content, 150_000), PieceBpe(b_content, 150_000)  # all caches share one worker
        self.known = Recent(200_000)
        #: where white space stands before a space, and the spaces that a word may begin with there
        self.doubtful, self.spaces = re.compile(r"\s "), re.compile(r"(?<=\S) ")
        if not self.b.model["prefix"] or any(chr(b) not in self.a.vocabulary for b in range(256)):
            raise ValueError("B must set a space before a text, A must have a token for each byte")
        # all tokens of A are units; special tokens' strings are plain text
        self.tracker = Backtracker(self.a.strings, self.a.compatible, 500_000, "\u0100")
        self.a.machine = None
        self.b_sizes, self.b_offsets, self.b_bytes = self.b.piece_sizes, self.b.offsets, self.b.bytes
        # decimal ids with what may follow them, as a table of bytes
        self.digits = {}
        for name, size, signs in (("a", len(self.a.sizes), ",|"), ("b", len(self.b_sizes), ",;")):
            words = [f"{i}{s}".encode() for s in signs for i in range(size)]
            sizes = np.array([len(w) for w in words], np.int64)
            self.digits[name] = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes, size

    def words(self, text: str) -> list[str]:
        """The text cut at spaces where both tokenizers cut it; before each word a space is left out.

        A has no piece with white space after other characters. B has no token with a
        space after another character, or else the text stays whole.
        """
        if self.b.words is None:
            return [text]
        if text[0] == " " or self.doubtful.search(text):
            return self.spaces.split(text)
        return text.split(" ")

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Of each word with a space before it the ids of A, then those of B with OF_B set, little-endian 32-bit."""
        pieces = [self.a.split.findall(" " + w) for w in words]
        known, whole = self.a.known, self.a.vocabulary
        new = known.refresh(set().union(*pieces))
        spelled = [p.encode().decode("latin-1") for p in new]
        # a piece that is a token needs no merging
        known.update((p, np.array([whole[t]], "<u4").tobytes()) for p, t in zip(new, spelled) if t in whole)
        rest = [(p, t) for p, t in zip(new, spelled) if t not in whole]
        every = np.arange(len(self.a.strings) + 1)
        known.update(zip([p for p, _ in rest], packed_words(*self.tracker.many([t for _, t in rest]), every, every)))
        of_b = self.b.encode_marked([SPACE + w.replace(" ", SPACE) for w in words])
        marked = (np.frombuffer(b"".join(of_b), "<u4") | np.uint32(OF_B)).tobytes()
        ends = np.cumsum([len(b) for b in of_b]).tolist()
        return [b"".join(map(known.__getitem__, p)) + marked[end - len(b) : end] for p, b, end in zip(pieces, of_b, ends)]

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A of all texts, how many each text has, ids of B, how many); none where either's bytes are not those of space and text.

        A has a token for each byte, so it keeps every text. B keeps all but the sign
        that it writes for a space, and letters that it has no id for. Long words are
        encoded each time they occur, so that the cache stays small.
        """
        words = [self.words(t) if t and SPACE not in t else [] for t in texts]
        known = self.known
        new = known.refresh(set().union(*words))
        coded = dict(zip(new, self.encode_words(new)))
        once = {w: coded.pop(w) for w in new if len(w) > CACHED_CHARS}
        known.update(coded)
        get = (lambda w: once[w] if w in once else known[w]) if once else known.__getitem__
        coded = [b"".join(map(get, w)) for w in words]
        n = np.array([len(c) // 4 for c in coded], np.int64)
        ids = np.frombuffer(b"".join(coded), "<u4")
        of_b = ids >= OF_B
        text = np.repeat(np.arange(len(texts)), n)
        if not self.b.model["bytes"]:
            lost = np.zeros(len(texts), bool)
            lost[text[ids == OF_B + self.b.model["unknown"]]] = True
            ids, of_b, text = (x[~lost[text]] for x in (ids, of_b, text))
        return ids[~of_b].astype(np.int64), np.bincount(text[~of_b], minlength=len(texts)), (ids[of_b] - OF_B).astype(np.int64), np.bincount(text[of_b], minlength=len(texts))

    def decimal(self, which: str, ids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and sizes, in the table of bytes, of ids with the sign that follows them."""
        _, offsets, sizes, size = self.digits[which]
        at = ids + size * last
        return offsets[at], sizes[at]


def group_texts(coders: Coders, i: np.ndarray, j: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, tokens: np.ndarray) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each document's ids and groups; tokens: how many of both kinds a document has."""
    last = lambda g: np.r_[g[1:] != g[:-1], True][: len(g)]
    table_a, table_b = coders.digits["a"][0], coders.digits["b"][0]
    both = np.concatenate([table_a, table_b])
    begin = np.empty(len(i) + len(j), np.int64)
    size = np.empty(len(i) + len(j), np.int64)
    at_a = np.arange(len(i)) + np.searchsorted(of_b, of_a, side="left")
    at_b = np.arange(len(j)) + np.searchsorted(of_a, of_b, side="right")
    begin[at_a], size[at_a] = coders.decimal("a", i, last(of_a))
    begin[at_b], size[at_b] = coders.decimal("b", j, last(of_b))
    begin[at_b] += len(table_a)
    whole = memoryview(b"".join([both[ranges(begin[k : k + WORK], size[k : k + WORK])].tobytes() for k in range(0, len(begin), WORK)]))
    ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(tokens)]].tolist()
    return [bytes(whole[a : max(a, b - 1)]) for a, b in zip(ends, ends[1:])]


def encoded_units(a_content: str, b_content: bytes, outputs: list[str]):
    """Task function: a row for each document with its key and counts, and one for each unit with its pairs and links."""

    def run(rows):
        import gc

        # caches of small objects make each collection dear, and nothing here is a cycle
        gc.disable()
        try:
            yield from units(rows)
        finally:
            gc.enable()

    def units(rows):
        import hashlib

        from pyspark import TaskContext

        cache, key = worker_cache("alignment"), (hash(a_content), hash(b_content))
        if key not in cache:
            cache[key] = Coders(a_content, b_content)
        coders = cache[key]
        row = TaskContext.get().partitionId() << 40
        for batch in rows:
            for part in parts(batch, "_whole", UNIT_BYTES):
                i, n_a, j, n_b = coders.encode_many(part.column(part.schema.get_field_index("_whole")).to_pylist())
                links_a, links_b, of_a, of_b = align(np.cumsum(coders.a.sizes[i]), np.cumsum(coders.b_sizes[j]))
                sizes = np.diff(np.searchsorted(links_a, np.cumsum(n_a), side="left"), prepend=0)
                texts = group_texts(coders, i, j, of_a, of_b, n_a + n_b)
                keys = np.arange(row, row + part.num_rows)
                row += part.num_rows
                found = {
                    "_key": pa.array(keys),
                    "_n_a": pa.array(n_a),
                    "_n_b": pa.array(n_b),
                    "_n_groups": pa.array(n_a + n_b - sizes),
                    "_n_links": pa.array(sizes),
                    "_groups_sha256": pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string()),
                    "_groups": pa.array([t.decode() for t in texts], pa.string()),
                }
                own = {f: part.column(k) for k, f in enumerate(part.schema.names) if f != "_whole"}
                none = {"pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int32()), "links": pa.binary(), "keys": pa.binary(), "sizes": pa.binary()}
                every = own | found
                yield pa.RecordBatch.from_pydict({f: every[f] if f in every else pa.nulls(part.num_rows, none[f]) for f in outputs})
                if not len(links_a):
                    continue
                codes = i[links_a] * len(coders.b_sizes) + j[links_b]
                narrow = np.int32 if len(coders.a.sizes) * len(coders.b_sizes) < 1 << 31 else np.int64
                pairs, place, counts = np.unique(codes.astype(narrow), return_inverse=True, return_counts=True)
                pairs = pairs.astype(np.int64)
                order = np.argsort(-counts, kind="stable")
                rank = np.empty(len(order), np.uint32 if len(order) > 1 << 16 else np.uint16)
                rank[order] = np.arange(len(order))
                with_links = np.flatnonzero(sizes)
                unit = {"pairs": [pairs[order]], "counts": [counts[order].astype(np.int32)], "links": [rank[place].tobytes()], "keys": [keys[with_links].tobytes()], "sizes": [sizes[with_links].tobytes()]}
                yield pa.RecordBatch.from_pydict({f: pa.array(unit[f], none[f]) if f in unit else pa.nulls(1, every[f].type) for f in outputs})
                # a unit's arrays are many times its text
                del i, j, links_a, links_b, of_a, of_b, texts, codes, pairs, place, counts, order, rank, unit
                give_back()

    return run


def resolved_links(frequent: np.ndarray, counts: np.ndarray, best: np.ndarray):
    """Task function over unit rows: sums of the frequent pairs' links for each document, and its links of rarer pairs as (key, pair, n)."""

    def run(rows):
        for batch in rows:
            for unit in batch.to_pylist():
                pairs = np.array(unit["pairs"], np.int64)
                at = np.minimum(np.searchsorted(frequent, pairs), max(len(frequent) - 1, 0))
                known = frequent[at] == pairs if len(frequent) else np.zeros(len(pairs), bool)
                links = np.frombuffer(unit["links"], np.uint32 if len(pairs) > 1 << 16 else np.uint16)
                keys, sizes = (np.frombuffer(unit[c], np.int64) for c in ("keys", "sizes"))
                begin = np.cumsum(sizes) - sizes
                total, top = (np.add.reduceat(np.where(known, x[at] if len(x) else 0, 0)[links], begin) for x in (counts, best))
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "pair": pa.nulls(len(keys), pa.int64()), "n": pa.nulls(len(keys), pa.int64()), "total": pa.array(total), "top": pa.array(top)})
                rare = np.flatnonzero(~known[links])
                if len(rare):
                    owner = np.searchsorted(begin, rare, side="right") - 1
                    one, n = np.unique(owner * len(pairs) + links[rare], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"key": pa.array(keys[one // len(pairs)]), "pair": pa.array(pairs[one % len(pairs)]), "n": pa.array(n), "total": pa.nulls(len(one), pa.int64()), "top": pa.nulls(len(one), pa.int64())})

    return run


def pair_counts(units: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best) over all units: how many links hold the pair, and 1 where no pair of its B id has more.

    The table of the highest counts has a row for each B id at most, which bounds its broadcast.
    """
    each = units.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    counted = stored(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("n")))
    of_b = F.col("pair") % n_b
    highest = counted.groupBy(of_b.alias("b")).agg(F.max("n").alias("highest"))
    return stored(counted.withColumn("b", of_b).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best")))


def align_tokens(docs: DataFrame, a_content: str, b_content: bytes, text_column: str = "text", groups: bool = False) -> DataFrame:
    """docs with `_n_a`, `_n_b`, `_n_groups`, `_n_links`, `_n_best`, `_count_sum`, `_groups_sha256` and, if asked, `_groups` in place of the text.

    A is a byte-level BPE file's content and encodes a space and the text; B is a
    SentencePiece BPE model's and encodes the text, before which it sets a space.
    Special tokens' strings are plain text. Byte places where tokens of both end cut
    them into groups; a link is a token of A and one of B whose bytes overlap. An
    id pair's count is the number of its links in all rows; `_n_best` counts the
    row's links whose pair has the highest count of its B id, ties included, and
    `_count_sum` adds the counts of all its links up.

    Null or empty text, and a text whose bytes either tokenizer does not keep (one
    with U+2581): no tokens, all numbers 0, `_groups` and its digest ''. Repeated rows
    each count. An empty table gives an empty one. A long text is one unit, encoded in
    linear time and merged in pieces of equal work. Own columns stay, whatever their
    names; one named as a new column gives way to it.
    """
    n_b = len(read_model(b_content)["pieces"])
    made = T.StructType.fromDDL("_key long, " + COUNTS + ", _groups string" * groups)
    new = [*made.names[1:], "_n_best", "_count_sum"]
    own = own_fields(docs, [*new, text_column])
    schema = T.StructType([T.StructField(f"own{k}", f.dataType) for k, f in enumerate(own)] + made.fields + T.StructType.fromDDL(UNIT).fields)
    rows = docs.select(*[column(f.name).alias(f"own{k}") for k, f in enumerate(own)], column(text_column).alias("_whole"))
    coded = stored(rows.mapInArrow(tidy(encoded_units(a_content, b_content, schema.names)), schema))
    units = coded.where("pairs is not null").select(*T.StructType.fromDDL(UNIT).names)
    counted = pair_counts(units, n_b)
    links = counted.agg(F.sum("n")).first()[0] or 0
    frequent = counted.where(F.col("n") * FREQUENT >= links).toArrow().sort_by("pair")
    tables = [frequent.column(c).to_numpy() for c in ("pair", "n", "best")]
    sums = stored(units.mapInArrow(tidy(resolved_links(*tables)), "key long, pair long, n long, total long, top long"))
    rare = sums.where("pair is not null").select("key", "pair", F.col("n").alias("links"))
    rare = rare.join(counted.where(F.col("n") * FREQUENT < links), "pair").select("key", (F.col("n") * F.col("links")).alias("total"), (F.col("best") * F.col("links")).alias("top"))
    each = sums.where("pair is null").select("key", "total", "top").union(rare).groupBy(F.col("key").alias("_key")).agg(F.sum("total").alias("_count_sum"), F.sum("top").alias("_n_best"))
    out = coded.where("_key is not null").select(*[f"own{k}" for k in range(len(own))], *made.names).join(each, "_key", "left").fillna(0, ["_count_sum", "_n_best"])
    return out.select(*[F.col(f"own{k}").alias(f.name) for k, f in enumerate(own)], *new)
