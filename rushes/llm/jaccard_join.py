"""N-gram Jaccard join by adaptive multi-match prefixes, down to connected components.

A document is the set of hashes of its word n-grams; equal sets are one class. In
hash order, two sets of n grams that overlap in c or more share l of the first
n - c + l (their l-prefix). Prefixes of several lengths are at hand (LEVELS). From the
exact numbers of classes that have each gram in their prefixes, each class estimates
how many candidates each length brings it and takes the cheapest. A longer prefix lets
a class leave its l - 1 most frequent grams out, as l shared grams are asked for; two
classes meet by the shorter of their prefixes.

Classes that meet at a gram are compared by the grams of their longest prefixes: only
those that share as many as the shorter of their demands, and as any link of their
sizes must have among them, are candidates. Where
candidates are few for the classes that have them, each pair is verified by itself:
a class meets its partners, at most BLOCK at a time, and whole sets are compared.
Where nearly all classes of a gram are each other's candidates, pairs would be
quadratic; such crowds are verified in blocks.

Classes whose first frequent gram is the same, more than a block of them, are
compared with PIVOTS of them before all that: those that link with one pivot are known
to be one component, so they need not meet each other, only the rest. Memory is bounded
by the blocks and no pair is lost; crowds and links leave a task as spanning forests.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import column, stored
from ._text import byte_values, grams, hashes, mix, parts, space_class, spans, tidy, utf8
from .components import components
from .packing import worker_cache

SIGNATURE = "id long, text_key long, n int, node long, grams array<long>"
BLOCK = 512
MEETING = 512
PIVOTS = 8
#: Shared grams that the longer prefixes ask for: n // divisor, at least so many. The shortest asks for one.
LEVELS = ((40, 2), (20, 3))
BROADCAST_ROWS = 100_000
#: Classes are told by so many hash values where only their texts are shuffled; no more are broadcast.
SLOTS = 1 << 20


def gram_sets(column, n: int):
    """The sorted distinct gram hashes of each text. A text of fewer words is one gram."""
    data, offsets = utf8(column)
    s, e, bounds = spans(data, offsets, space_class())
    words = hashes(data, s, e, byte_values(lower=True))
    whole = grams(words, n)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            yield np.unique(whole[a : b - n + 1])
        elif b > a:
            yield mix(grams(words[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def overlap(n, percent: int):
    """How many grams a set of n shares at least with any set it links with."""
    return (percent * n + 99) // 100


def level(n, percent: int):
    """How many shared grams the longest prefix asks for."""
    divisor, least = LEVELS[-1]
    return np.minimum(overlap(n, percent), np.maximum(least, n // divisor))


def linked_overlap(n, m, percent: int):
    """How many grams sets of n and m share at least if they link."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


def node_of(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(n: int, percent: int):
    """Task function: rows to set size, class and longest prefix."""

    def run(rows):
        worker_cache("jaccard_join")
        for batch in (part for batch in rows for part in parts(batch, "text")):
            names = batch.schema.names
            sizes, nodes, prefixes = [], [], []
            for found in gram_sets(batch.column(names.index("text")), n):
                size = len(found)
                sizes.append(size)
                nodes.append(node_of(found) if size else None)
                prefixes.append(found[: size - overlap(size, percent) + int(level(size, percent))].view(np.int64) if size else None)
            yield pa.RecordBatch.from_arrays([batch.column(names.index("id")), batch.column(names.index("text_key")), pa.array(sizes, pa.int32()), pa.array(nodes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))], names=["id", "text_key", "n", "node", "grams"])

    return run


def trees(m: int, pairs) -> list[tuple[list[int], list[tuple[int, int]]]]:
    """(places, their pairs) of each connected group of the places that have pairs."""
    root = list(range(m))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs:
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    found: dict[int, tuple[list, list]] = {}
    for x, y in pairs:
        found.setdefault(find(x), (set(), []))[1].append((x, y))
    for places, own in found.values():
        places.update(p for pair in own for p in pair)
    return [(sorted(places), own) for places, own in found.values()]


def groups(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place of each place's connected group, by pairs of places."""
    least = np.arange(m)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = np.minimum(new, new[new])
        if (new == least).all():
            return least
        least = new


def crowded(places, pairs):
    """Whether blocks of all places cost less than the pairs one by one."""
    return (pairs >= places) & ((places <= 16) | (pairs > 2 * places))


def by_cell(rows, keys, columns):
    """Rows of sorted batches, cell by cell: each node of a cell once, with its columns' values."""
    key, held = None, {}
    for batch in (part for batch in rows for part in (parts(batch, "text") if "text" in batch.schema.names else (batch,))):
        names = batch.schema.names
        cells = zip(*(batch.column(names.index(c)).to_pylist() for c in keys))
        for cell, (node, row) in zip(cells, columns(batch)):
            if cell != key:
                if len(held) > 1:
                    yield key, held
                key, held = cell, {}
            if node not in held:
                held[node] = row
    if len(held) > 1:
        yield key, held


def near(sizes, levels, shared, percent, twice=0):
    """The pairs of places that share enough grams of their longest prefixes and are near in size.

    Of what two sets share, all that is not behind the prefix that ends first lies in both
    prefixes; so a link shares there what it needs but for the grams behind one of them.

    twice: how many of a place's grams have another's fingerprint, and may count once instead of twice.
    """
    a, b = np.triu_indices(len(sizes), 1)
    small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    behind = overlap(sizes, percent) - levels
    asked = np.maximum(np.minimum(levels[a], levels[b]), linked_overlap(small, large, percent) - np.maximum(behind[a], behind[b]))
    asked = asked - (np.minimum(twice[a], twice[b]) if np.ndim(twice) else twice)
    hit = (shared[a, b] >= asked) & (100 * small >= percent * large)
    return a[hit], b[hit]


class Joined:
    """Which nodes one task has joined already, so that it need not tell again."""

    def __init__(self, most: int = 100_000):
        self.root, self.most = {}, most

    def find(self, x):
        while (y := self.root.setdefault(x, x)) != x:
            self.root[x] = x = self.root[y]
        return x

    def one(self, nodes) -> bool:
        """Whether all of these nodes are known to be joined."""
        return all(x in self.root for x in nodes) and len({self.find(x) for x in nodes}) == 1

    def new(self, a, b) -> bool:
        if len(self.root) > self.most:
            self.root.clear()
        a, b = self.find(a), self.find(b)
        if a != b:
            self.root[max(a, b)] = min(a, b)
        return a != b


def with_known(third: str):
    """What by_cell has of a batch: each node with its size, its known grams and one more column."""

    def columns(batch):
        names = batch.schema.names
        known = batch.column(names.index("known"))
        values, cuts = known.values.to_numpy(), known.offsets.to_numpy()
        return zip(batch.column(names.index("node")).to_pylist(), zip(batch.column(names.index("n")).to_pylist(), (values[a:b] for a, b in zip(cuts[:-1], cuts[1:])), batch.column(names.index(third)).to_pylist()))

    return columns


def cells_led(percent: int):
    """Task function over rows sorted by cell: the rows of classes that are candidates of one that leads, and of the leading ones that have any."""

    def run(rows):
        out = []
        for (bucket, i, j), cell in by_cell(rows, ("bucket", "i", "j"), with_known("leads")):
            nodes, (sizes, known, leads) = list(cell), zip(*cell.values())
            few, sizes, leads = [np.unique(k) for k in known], np.array(sizes), np.array(leads)
            twice = np.array([len(k) - len(f) for k, f in zip(known, few)])
            a, b = near(sizes, level(sizes, percent), _common(few), percent, twice)
            led = leads[a] | leads[b]
            out += [(bucket, i, j, nodes[x], bool(leads[x])) for x in np.unique(np.r_[a[led], b[led]]).tolist()]
            if len(out) > 20_000:
                yield _cell_rows(out)
                out = []
        if out:
            yield _cell_rows(out)

    return run


def _cell_rows(out):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()))], names=["bucket", "i", "j", "node", "leads"])


def cells_met(percent: int):
    """Task function over rows sorted by cell: shared grams of prefixes to candidates (a, b), one by one or as the forest of a crowd.

    known has 16 bits of each gram: enough to count by, and never a candidate less.
    """

    def run(rows):
        out, joined, told = [], Joined(), set()  # what this task has told already
        seen: set[tuple | bytes] = set()
        once: dict[int, tuple[np.ndarray, int]] = {}  # distinct known grams of nodes, and how many are left out so

        def distinct(node, known):
            if (found := once.get(node)) is None:
                if len(once) > 20_000:
                    once.clear()
                few = np.unique(known)
                found = once[node] = few, len(known) - len(few)
            return found

        def tell(nodes, pairs):
            for x, y in pairs:
                pair = min(nodes[x], nodes[y]), max(nodes[x], nodes[y])
                if pair not in told:
                    told.add(pair)
                    out.append((*pair, False))

        def crowd(nodes, places):
            first = nodes[places[0]]
            out.extend((first, nodes[x], True) for x in places[1:] if joined.new(first, nodes[x]))

        for _, cell in by_cell(rows, ("level", "gram", "i", "j"), with_known("label")):
            nodes, (sizes, known, labels) = list(cell), zip(*cell.values())
            # the same nodes say the same again, and a crowd meets whole later on
            same = tuple(nodes) if len(nodes) <= 6 else hashlib.blake2b(np.array(nodes).tobytes(), digest_size=16).digest()
            if same in seen or joined.one(nodes):
                continue
            if len(seen) > 100_000:
                seen.clear()
            seen.add(same)
            if len(cell) <= 6:  # sets are quicker than arrays for a few
                few = [set(k.tolist()) for k in known]
                twice = [len(k) - len(f) for k, f in zip(known, few)]
                asks = [int(level(k, percent)) for k in sizes]
                behind = [overlap(k, percent) - a for k, a in zip(sizes, asks)]
                need = lambda x, y: max(min(asks[x], asks[y]), linked_overlap(sizes[x], sizes[y], percent) - max(behind[x], behind[y])) - min(twice[x], twice[y])  # noqa: B023, E731
                hit = [(x, y) for y in range(len(few)) for x in range(y) if 100 * min(sizes[x], sizes[y]) >= percent * max(sizes[x], sizes[y]) and len(few[x] & few[y]) >= need(x, y)]
                # of one component already
                hit = [(x, y) for x, y in hit if labels[x] is None or labels[x] != labels[y]]
                for places, pairs in trees(len(nodes), hit):
                    if crowded(len(places), len(pairs)):
                        crowd(nodes, places)
                    else:
                        tell(nodes, pairs)
            else:
                sizes = np.array(sizes)
                few, twice = zip(*map(distinct, nodes, known))
                a, b = near(sizes, level(sizes, percent), _common(few), percent, np.array(twice))
                codes = {label: k for k, label in enumerate(set(labels))}
                label = np.array([-1 - k if x is None else codes[x] for k, x in enumerate(labels)])
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                least = groups(len(nodes), a, b)
                pairs, places = np.bincount(least[a], minlength=len(nodes)), np.bincount(least, minlength=len(nodes))
                dense = crowded(places, pairs)
                for one in np.flatnonzero(dense & (places > 1)).tolist():
                    crowd(nodes, np.flatnonzero(least == one).tolist())
                single = ~dense[least[a]]
                tell(nodes, zip(a[single].tolist(), b[single].tolist()))
            if len(told) > 100_000:
                told.clear()
            if len(out) > 20_000:
                yield _pairs(out)
                out.clear()
        if out:
            yield _pairs(out)

    return run


def _pairs(out):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "crowd"])


def cells_linked(n: int, percent: int):
    """Task function over rows sorted by cell: texts to links (a, b) of classes, as a forest.

    Where a cell has rows that lead, only they are compared with the others.
    """

    def columns(batch):
        names = batch.schema.names
        return zip(batch.column(names.index("node")).to_pylist(), zip(gram_sets(batch.column(names.index("text")), n), batch.column(names.index("leads")).to_pylist()))

    def run(rows):
        joined, out = Joined(), []
        for _, cell in by_cell(rows, ("bucket", "i", "j"), columns):
            nodes, (sets, leads) = list(cell), zip(*cell.values())
            sizes, leads = np.array([len(s) for s in sets]), np.array(leads)
            levels = level(sizes, percent)
            if leads.any():
                lead = np.flatnonzero(leads)
                a, b = (x.ravel() for x in np.meshgrid(lead, np.arange(len(sets)), indexing="ij"))
                some = ~leads[b] | (a < b)
                a, b = a[some], b[some]
                near_size = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
                a, b = a[near_size], b[near_size]
                both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist())], np.int64)
            else:
                prefixes = [s[: k - overlap(k, percent) + int(j)] for s, k, j in zip(sets, sizes.tolist(), levels)]
                a, b = near(sizes, levels, _common(prefixes), percent)
                used = np.unique(np.r_[a, b])
                where = np.searchsorted(used, np.arange(len(sets)))
                both = _common([sets[i] for i in used.tolist()])[where[a], where[b]] if len(a) else np.zeros(0, np.int64)
            hit = 100 * both >= percent * (sizes[a] + sizes[b] - both)
            out += [(nodes[x], nodes[y]) for x, y in zip(a[hit].tolist(), b[hit].tolist()) if joined.new(nodes[x], nodes[y])]
            if len(out) > 20_000:
                yield _links(out)
                out = []
        if out:
            yield _links(out)

    return run


def _links(out):
    a, b = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    m = len(sets)
    out = np.zeros((m, m), np.float32)
    if m:
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(m), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        new = np.r_[True, every[1:] != every[:-1]][: len(every)]
        number = np.cumsum(new) - 1
        many = np.bincount(number)[number] > 1
        number, owner = number[many], owner[many]
        number = np.cumsum(np.r_[True, number[1:] != number[:-1]][: len(number)]) - 1
        for low in range(0, int(number.max(initial=-1)) + 1, 4096):
            part = slice(*np.searchsorted(number, [low, low + 4096]))
            grid = np.zeros((m, 4096), np.float32)
            grid[owner[part], number[part] - low] = 1
            out += grid @ grid.T
    return out.astype(np.int64)


def _blocks(count: str, size: int):
    return F.ceil(F.col(count) / F.lit(size)).cast("int").alias("blocks")


def _join_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their group's columns. Groups of many rows (k) are joined by broadcast, as no task should have one whole."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = stored(groups)
    # no more than 8 * parts groups have more rows than this
    limit = max((groups.agg(F.sum("k")).first()[0] or 0) // (8 * parts), 1)
    hot, others = F.broadcast(groups.where(F.col("k") > limit).drop("k")), groups.where(F.col("k") <= limit).drop("k")
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(others, keys))


def _cells(members: DataFrame, keys: list[str], size: int) -> DataFrame:
    """members (keys, k, node, label) with their cells i, j: a group of more than size has a cell for each two of its blocks.

    A group has a power of two of blocks, by the node alone, so groups of like members have like cells.

    Of such a group, those of the label that most have lie in blocks of their own, and
    such blocks don't meet each other.
    """
    few = members.where(F.col("k") <= size).select(*keys, "node", F.lit(0).alias("i"), F.lit(0).alias("j"))
    many = members.where(F.col("k") > size)
    labels = many.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    main = labels.groupBy(*keys).agg(F.max(F.when(F.col("label").isNotNull(), F.struct("n", "label"))).alias("main"), F.sum("n").alias("k"))
    inner = F.coalesce(F.col("main")["n"], F.lit(0))
    power = lambda x: F.when(x > 0, F.pow(F.lit(2), F.ceil(F.log2(F.greatest(x, F.lit(1.0)))))).otherwise(0).cast("int")
    blocks = main.select(*keys, "k", F.col("main")["label"].alias("main"), power((F.col("k") - inner) / size).alias("rest"), power(inner / size).alias("blocks")).where("rest > 0")
    rows = _join_groups(many.drop("k"), blocks, keys).withColumn("inside", F.coalesce(F.col("label") == F.col("main"), F.lit(False)))
    place = F.xxhash64("node")
    mine = F.when(F.col("inside"), F.col("rest") + F.pmod(place, F.greatest("blocks", F.lit(1)))).otherwise(F.pmod(place, F.col("rest"))).cast("int")
    every = F.sequence(F.lit(0), F.col("rest") + F.col("blocks") - 1)
    others = F.when(F.col("inside"), F.sequence(F.lit(0), F.col("rest") - 1)).when(F.size(every) == 1, every).otherwise(F.array_except(every, F.array("mine")))
    met = rows.withColumn("mine", mine).withColumn("other", F.explode(others))
    return few.unionByName(met.select(*keys, "node", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")))


def _prefixes(percent: int):
    """For each level, the columns that a class posts its grams by: those of its prefix without the most frequent."""
    n, least = F.col("n"), F.expr(f"({percent} * n + 99) div 100")
    for divisor, fewest in ((None, 1), *LEVELS):
        asked = F.lit(1) if divisor is None else F.least(least, F.greatest(F.lit(fewest), F.expr(f"n div {divisor}"))).cast("int")
        end = n - least + asked
        inside = F.filter("known", lambda g: g["place"] < end)  # noqa: B023
        # grams of one class alone come first in the order of frequency, and meet nobody
        yield F.slice(inside, F.lit(1), F.greatest(F.size(inside) - asked + 1, F.lit(0)))


def _met(chosen: DataFrame) -> DataFrame:
    """(level, gram, least, k, node): the classes of each gram where two can meet, and the least of them."""
    meets = chosen.select("node", "home", F.posexplode("posts").alias("level", "grams")).where("level <= home").select("node", "home", "level", F.explode("grams").alias("gram"))
    groups = meets.groupBy("level", "gram").agg(F.max((F.col("home") == F.col("level")).cast("int")).alias("homes"), F.count("*").alias("k"), F.min("node").alias("least")).where("homes = 1 and k > 1").select("level", "gram", "k", "least", F.col("k").alias("_k"))
    return _join_groups(meets.select("node", "level", "gram"), groups, ["level", "gram"]).withColumnRenamed("_k", "k")


def _verified(cells: DataFrame, texts: DataFrame, classes: DataFrame, gram: int, percent: int, parts: int) -> DataFrame:
    """Links (a, b) of the classes that cells (bucket, i, j, node, leads) bring together."""
    placed = stored(cells.join(classes.select("node", F.col("one")["id"].alias("id"), F.col("one")["text_key"].alias("text_key")), "node"))
    # only texts whose slot is asked for are shuffled; where all slots are, all texts
    slot = F.pmod(F.xxhash64("text_key", "id"), F.lit(SLOTS)).cast("int").alias("slot")
    asked = F.broadcast(placed.select(slot).distinct())
    some = texts.select("*", slot).join(asked, "slot", "left_semi").drop("slot")
    right = placed.select("bucket", "i", "j", "node", "leads", F.col("id").alias("_id"), F.col("text_key").alias("_text_key"))
    both = some.join(right, (F.col("text_key") == F.col("_text_key")) & F.col("id").eqNullSafe(F.col("_id")))
    rows = both.select("bucket", "i", "j", "node", "leads", "text").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", F.desc("leads"), "node")
    return stored(rows.mapInArrow(tidy(cells_linked(gram, percent)), "a long, b long"))


def _one_by_one(pairs: DataFrame) -> DataFrame:
    """Cells for candidate pairs: a class leads its partners, a block of them at a time."""
    degree = pairs.groupBy("a").agg(F.count("*").alias("m")).select("a", _blocks("m", BLOCK))
    dealt = pairs.join(degree, "a").withColumn("i", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    partners = dealt.select(F.col("a").alias("bucket"), "i", F.lit(-1).alias("j"), F.col("b").alias("node"), F.lit(False).alias("leads"))
    leaders = degree.select(F.col("a").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(-1).alias("j"), F.col("a").alias("node"), F.lit(True).alias("leads"))
    return partners.unionByName(leaders)


def _by_pivots(large: DataFrame) -> DataFrame:
    """Cells for large crowds (bucket, node, m): some of a crowd's classes lead each block of it."""
    dealt = large.select("bucket", "node", "m", _blocks("m", max(BLOCK // 4, 1)))
    members = dealt.select("bucket", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("i"), F.lit(0).alias("j"), "node", F.lit(False).alias("leads"))
    pivots = dealt.where(F.expr(f"pmod(xxhash64(node, m), greatest(m div {PIVOTS}, 1)) = 0"))
    leaders = pivots.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"), "node", F.lit(True).alias("leads"))
    return members.unionByName(leaders)


def link_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", gram: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles and component_id for each row: the least id that links reach, its own included.

    Texts are words without ASCII white space, A-Z in lower case; two link when
    their sets of word n-grams share at least percent of their union. A text of fewer
    words is one gram.

    Null, empty and wordless texts have an empty set and link with nothing. Null id: a row
    like any other; a component of rows without any id has a null id. Rows that repeat an
    id are linked by their texts alone. Long texts are compared whole. An empty table gives
    an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = column(text_column)
    texts = docs.select(column(id_column).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    signed = stored(texts.mapInArrow(tidy(signatures(gram, percent)), SIGNATURE))
    classes = signed.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_key")).alias("one"), F.first("n").alias("n"), F.first("grams").alias("grams"))
    postings = classes.select("node", "n", F.posexplode("grams").alias("place", "gram"))
    often = classes.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = postings.join(often, "gram")

    per_class = shared.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram", "place"))).alias("known"))
    # whoever links shares what the lesser of the two asks for; a partner has the set's least overlap at least
    divisor, least = LEVELS[-1]
    fewest = F.least(F.expr(f"({percent} * ({percent} * n + 99) div 100 + 99) div 100"), F.greatest(F.lit(least), F.expr(f"({percent} * n + 99) div {100 * divisor}")))
    per_class = per_class.where(F.size("known") >= fewest)
    posts = F.array(*_prefixes(percent))
    cost = F.transform("posts", lambda grams: F.aggregate(grams, F.lit(0).cast("long"), lambda total, g: total + g["df"] - 1))
    crowd = F.array_min(F.transform(F.filter("known", lambda g: g["df"] > MEETING), lambda g: F.struct(g["place"], g["gram"])))
    chosen = stored(
        per_class.withColumn("posts", posts)
        .withColumn("cost", cost)
        .select("node", "n", crowd["gram"].alias("crowd"), F.expr("cast(array_position(cost, array_min(cost)) - 1 as int)").alias("home"), F.expr("transform(known, g -> cast((g.gram & 65535) - 32768 as smallint))").alias("known"), F.transform("posts", lambda grams: F.transform(grams, lambda g: g["gram"])).alias("posts"))
    )
    verify = lambda cells: _verified(cells, texts, classes, gram, percent, parts)
    # classes whose first frequent gram is the same, if there are more than a block of them
    sizes = chosen.where("crowd is not null").groupBy("crowd").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).withColumn("k", F.col("m"))
    large = stored(_join_groups(chosen.where("crowd is not null").select("node", "crowd"), sizes, ["crowd"]).select(F.col("crowd").alias("bucket"), "node", "m"))
    first = None
    if large.limit(1).count():
        # what is known of the classes goes first: only candidates' texts follow
        led = _by_pivots(large).join(chosen.select("node", "n", "known"), "node").repartition(parts, "bucket", "i", "j")
        led = led.sortWithinPartitions("bucket", "i", "j", F.desc("leads"), "node").mapInArrow(tidy(cells_led(percent)), "bucket long, i int, j int, node long, leads boolean")
        first = verify(led)
    known = chosen.select("node", "n", "known", F.lit(None).cast("long").alias("label"))
    if first is not None:
        known = stored(known.drop("label").join(components(first), "node", "left"))

    # stored, as it is read for the few, the many and their labels
    met = _cells(stored(_met(chosen).join(known.select("node", "label"), "node")), ["level", "gram", "least"], MEETING)
    # a class's grams that go the same way travel as one row, with what is known of the class once
    packed = met.repartition(parts, "node").groupBy("node", "least", "i", "j").agg(F.collect_list(F.struct("level", "gram")).alias("posts")).join(known, "node")
    # grams of like classes lie in one task, which tells of their candidates once
    dealt = packed.repartition(parts, "least", "i", "j").select("i", "j", "node", "n", "known", "label", F.explode("posts").alias("post")).select("post.level", "post.gram", "i", "j", "node", "n", "known", "label")
    candidates = stored(dealt.sortWithinPartitions("level", "gram", "i", "j", "node").mapInArrow(tidy(cells_met(percent)), "a long, b long, crowd boolean"))

    crowds = components(candidates.where("crowd")).withColumnRenamed("label", "bucket")
    crowds = _join_groups(crowds, crowds.groupBy("bucket").agg(F.count("*").alias("k"), F.count("*").alias("_k")), ["bucket"]).withColumnRenamed("_k", "k")
    crowds = _cells(crowds.join(known.select("node", "label"), "node"), ["bucket"], BLOCK).withColumn("leads", F.lit(False))
    links = verify(_one_by_one(candidates.where("not crowd").select("a", "b").distinct()).unionByName(crowds))
    joined = components(links if first is None else links.unionByName(first))
    named = classes.select("node", F.col("one")["id"].alias("first_id")).join(joined, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label"))
    least_id = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    resolved = stored(named.join(least_id, "label").select("node", "component_id"))
    return signed.select("id", "n", "node").join(resolved, "node", "left").select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
