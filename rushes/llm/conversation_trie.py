"""Prefix trie of conversations by fixed-length block hashing.

A turn's digest is 128 bits of role and text. A prefix's digest is the exclusive or
of its turns' digests, each tagged with its place, so prefixes are scanned in
parallel: within stretches of a conversation first, then over stretches. Conversations
are cut into blocks of BLOCK turns and grouped by the digests before and after each
block. Where all conversations that go on from a block's end go on alike, the nodes
inside the next block have the members of its end and are only written out; where
siblings diverge, one conversation for each distinct block stands for all of its
copies, and its turns are grouped one by one.

A node is owned by its smallest member, and what a conversation owns is the lower end
of its path. So sums over subtrees are sums over members: a leaf counts in each node
that its owner is a member of, and so do the tokens saved at the nodes it owns,
but for those above the node itself. No step goes down the trie level by level,
and all sums are combined before they are shuffled.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import column, stored
from ._text import tidy

BLOCK = 4
#: Turns of a conversation that one scan goes through; a multiple of BLOCK.
STRETCH = 4096
#: Keys with at least one in so many rows are joined by broadcast; there are at most so many.
SHARE = 1024
CHUNK_IDS = 8192
PATHS = "conv long, pos long, d1 long, d2 long, bytes long, depth long"
NODE = ["pos", "p1", "p2"]


def turn_digests(rows):
    """Task function: 128 bits of each turn's role and text, and the text's bytes."""
    from hashlib import blake2b

    for batch in rows:
        digests, sizes = [], []
        for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            role, text = role.encode(), text.encode()
            digests.append(blake2b(len(role).to_bytes(8, "little") + role + text, digest_size=16).digest())
            sizes.append(len(text))
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sizes, pa.int64())], names=["conv", "turn", "d1", "d2", "bytes"])


def places(rows):
    """Task function over sorted rows: each row's place among its conversation's rows in this task."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, seen = None, 0
    for batch in rows:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy()
        new = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        place = np.arange(len(conv)) - np.repeat(new, np.diff(new, append=len(conv)))
        if conv[0] == last:
            place[: new[1] if len(new) > 1 else len(conv)] += seen
        last, seen = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part, np.int32)), batch.column(0), pa.array(place + 1), *[batch.column(i) for i in (2, 3, 4)]], names=["part", "conv", "place", "d1", "d2", "bytes"])


def numbered_turns(turns: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """(conv, n, d1, d2, bytes): each turn's number from 1 in its conversation.

    Rows are range-partitioned by conversation, turn and digest, so a conversation of
    any length lies in several tasks; equal rows are told apart by the place they were
    read at, so that they part as well. Each task has at most one conversation that began in
    a task before it, so the table of what came before has a row for each task at most.
    """
    clean = turns.where(column(id_column).isNotNull()).select(column(id_column).cast("long").alias("conv"), column(turn_column).alias("turn"), F.coalesce(column(role_column).cast("string"), F.lit("")).alias("role"), F.coalesce(column(text_column).cast("string"), F.lit("")).alias("text"))
    kind = clean.schema["turn"].dataType.simpleString()
    small = clean.mapInArrow(tidy(turn_digests), f"conv long, turn {kind}, d1 long, d2 long, bytes long").withColumn("read_at", F.monotonically_increasing_id())
    n_parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", F.col("turn").asc_nulls_first(), "d1", "d2", "read_at"]
    placed = stored(small.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInArrow(tidy(places), "part int, conv long, place long, d1 long, d2 long, bytes long"))
    before = F.sum("rows").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    begun = placed.groupBy("conv", "part").agg(F.max("place").alias("rows")).select("conv", "part", before.alias("before")).where("before is not null")
    return placed.join(F.broadcast(begun), ["conv", "part"], "left").select("conv", (F.col("place") + F.coalesce("before", F.lit(0))).alias("n"), "d1", "d2", "bytes")


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int) -> DataFrame:
    """left joined with right, where right has each key once and, in the column rows, how often left has it, of total rows in all.

    Keys with over one in SHARE of the rows are at most SHARE, so they are broadcast; the others spread when shuffled.
    """
    hot = F.col(rows) * SHARE > total
    asked = left.join(F.broadcast(right.where(hot).select(*keys).withColumn("_hot", F.lit(True))), keys, "left")
    by_broadcast = asked.where("_hot").drop("_hot").join(F.broadcast(right.where(hot)), keys)
    return by_broadcast.unionByName(asked.where("_hot is null").drop("_hot").join(right.where(~hot), keys))


def rebuilt_paths(turns: DataFrame, group: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Paths (PATHS) of the rebuilt conversations, and (conv, depth) of all of them.

    Conversation c begins with the first h turns of c - c % group (all if it has fewer,
    none if it is absent), h being crc32 of c in decimal % heads; its own turns after its
    first h follow. With heads 1 every conversation stays as it is.
    """
    sizes = stored(turns.groupBy("conv").agg(F.max("n").alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    base = F.col("conv") - F.col("conv") % group
    convs = sizes.select("conv", "size", h.alias("h"), base.alias("base")).join(sizes.select(F.col("conv").alias("base"), F.col("size").alias("base_size")), "base", "left")
    head = F.least("h", F.coalesce("base_size", F.lit(0)))
    convs = stored(convs.select("conv", "size", "h", "base", head.alias("head"), (head + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("depth")))
    own = looked_up(turns, convs.select("conv", "size", "h", "head", "depth"), ["conv"], "size", total).where("n > h").select("conv", (F.col("head") + F.col("n") - F.col("h")).alias("pos"), "d1", "d2", "bytes", "depth")
    lent = turns.where((F.col("n") < heads) & (F.col("conv") % group == 0)).withColumnRenamed("conv", "base")
    begins = convs.select("conv", "base", "head", "depth").join(lent, "base").where("n <= head").select("conv", F.col("n").alias("pos"), "d1", "d2", "bytes", "depth")
    return own.unionByName(begins), convs.select("conv", "depth")


def path_blocks(paths: DataFrame) -> DataFrame:
    """(conv, k, q1, q2, e1, e2, last, depth, turns): blocks with the digests of the prefixes before and at the end; turns has each prefix's pos, digest and last text's bytes."""
    tagged = paths.select("conv", "pos", "bytes", "depth", F.floor((F.col("pos") - 1) / STRETCH).alias("stretch"), F.floor((F.col("pos") - 1) / BLOCK).alias("k"), F.xxhash64("d1", "d2", "pos").alias("x1"), F.xxhash64("pos", "d2", F.lit(BLOCK), "d1").alias("x2"))
    within = Window.partitionBy("conv", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    scanned = tagged.withColumns({"p1": F.bit_xor("x1").over(within), "p2": F.bit_xor("x2").over(within)})
    # (conv, stretch) already parts the rows, so this is no further shuffle
    found = scanned.groupBy("conv", "stretch", "k").agg(F.sort_array(F.collect_list(F.struct("pos", "p1", "p2", "bytes"))).alias("turns"), F.min(F.struct("pos", "p1", "p2", "x1", "x2")).alias("first"), F.max("depth").alias("depth"))
    found = stored(found)
    ends = found.groupBy("conv", "stretch").agg(F.max(F.struct("k", F.element_at("turns", -1).alias("end"))).alias("end")).where("stretch >= 0")
    over = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    long_ = found.where("stretch > 0").select("conv").distinct()
    before = ends.join(long_, "conv", "left_semi").select("conv", "stretch", F.bit_xor("end.end.p1").over(over).alias("o1"), F.bit_xor("end.end.p2").over(over).alias("o2")).where("stretch > 0")
    out = found.join(before, ["conv", "stretch"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("o1", "o2")})
    put = lambda t: F.struct(t["pos"].alias("pos"), t["p1"].bitwiseXOR(F.col("o1")).alias("p1"), t["p2"].bitwiseXOR(F.col("o2")).alias("p2"), t["bytes"].alias("bytes"))
    out = out.withColumn("turns", F.transform("turns", put)).withColumn("end", F.element_at("turns", -1))
    first = {f"q{i}": F.col(f"first.p{i}").bitwiseXOR(F.col(f"first.x{i}")).bitwiseXOR(F.col(f"o{i}")) for i in (1, 2)}
    return stored(out.select("conv", "k", *[x.alias(n) for n, x in first.items()], F.col("end.p1").alias("e1"), F.col("end.p2").alias("e2"), F.col("end.pos").alias("last"), "depth", "turns"))


def written_out(blocks: DataFrame) -> DataFrame:
    """A row for each turn of one conversation of each distinct block: the node it stands at, that node's parent, and the block's members.

    diverges says whether the block has siblings: where it has none its nodes need no grouping.
    """
    groups = stored(blocks.groupBy("k", "q1", "q2", "e1", "e2").agg(F.count("*").alias("n"), F.min("conv").alias("owner")))
    siblings = groups.groupBy("k", "q1", "q2").agg(F.count("*").alias("siblings"))
    flagged = looked_up(groups, stored(siblings), ["k", "q1", "q2"], "siblings", groups.count())
    one = flagged.join(blocks.select(F.col("conv").alias("owner"), "k", "turns"), ["owner", "k"])
    turn = one.select("k", "q1", "q2", "e1", "e2", "n", "owner", (F.col("siblings") > 1).alias("diverges"), "turns", F.posexplode("turns").alias("i", "t"))
    parent = lambda c, q: F.when(F.col("i") == 0, F.col(q)).otherwise(F.get("turns", F.col("i") - 1)[c]).alias(q)
    return stored(turn.select("k", "e1", "e2", "n", "owner", "diverges", "t.pos", "t.p1", "t.p2", "t.bytes", parent("p1", "q1"), parent("p2", "q2")))


def end_digests(ends: DataFrame) -> DataFrame:
    """(pos, p1, p2, ends): SHA-256 of the decimal ids, ascending, that end at a node.

    Ids are sorted over all tasks and packed into chunks, so that even the node where
    most conversations end is hashed from few rows.
    """
    n_parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def packed(rows):
        key, ids = None, []

        def chunk():
            return pa.RecordBatch.from_pydict({"pos": pa.array([key[0]], pa.int64()), "p1": pa.array([key[1]], pa.int64()), "p2": pa.array([key[2]], pa.int64()), "least": pa.array([ids[0]], pa.int64()), "ids": pa.array([",".join(map(str, ids)).encode()], pa.binary())})

        done = []
        for batch in rows:
            for *now, conv in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if now != key or len(ids) >= CHUNK_IDS:
                    if ids:
                        done.append(chunk())
                    key, ids = now, []
                ids.append(conv)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if ids:
            yield chunk()

    def hashed(rows):
        from hashlib import sha256

        key, state = None, None
        columns = lambda found: pa.RecordBatch.from_arrays([*[pa.array([f[0][i] for f in found], pa.int64()) for i in range(3)], pa.array([f[1] for f in found], pa.string())], names=[*NODE, "ends"])
        for batch in rows:
            found = []
            for *now, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)]):
                if now != key:
                    if key:
                        found.append((key, state.hexdigest()))
                    key, state = now, sha256()
                else:
                    state.update(b",")
                state.update(ids)
            if found:
                yield columns(found)
        if key:
            yield columns([(key, state.hexdigest())])

    order = [*NODE, "conv"]
    chunks = ends.select(*order).repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInArrow(tidy(packed), "pos long, p1 long, p2 long, least long, ids binary")
    return chunks.repartition(n_parts, *NODE).sortWithinPartitions(*NODE, "least").mapInArrow(tidy(hashed), "pos long, p1 long, p2 long, ends string")


def conversation_trie(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", group: int = 5, heads: int = 9) -> DataFrame:
    """A row for each node of the prefix trie of rebuilt conversations (see rebuilt_paths): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation's rows are in the order of turn, null first; rows of equal turn are
    in the order of a hash of role and text, and equal rows follow each other, each a
    turn of its own. Null role or text is empty. Rows with a null id belong to no conversation
    and take no part; ids may be negative. Texts may be of any length and other columns
    of any name. A conversation that is left without turns ends at the root. An empty
    table has no root and gives an empty table.
    """
    spark = turns.sparkSession
    paths, convs = rebuilt_paths(numbered_turns(turns, id_column, turn_column, role_column, text_column), group, heads)
    blocks = path_blocks(paths)
    turn = written_out(blocks)
    alike = [*NODE, "q1", "q2", "bytes", "n", "owner"]
    grouped = turn.where("diverges").groupBy(*NODE, "q1", "q2", "bytes").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"))
    nodes = stored(turn.where("not diverges").select(*alike).unionByName(grouped.select(*alike)))

    children = nodes.groupBy((F.col("pos") - 1).alias("pos"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    children = stored(children)
    stretch = F.floor(F.col("pos") / STRETCH)
    tree = stored(nodes.join(children, NODE, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "saved": (F.col("n") - 1) * F.col("bytes"), "stretch": stretch}))

    # what the owner saves at nodes above, by stretches of its path and within them
    owned = tree.groupBy("owner", "stretch").agg(F.sum("saved").alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"), F.count("*").alias("rows"))
    owned = stored(owned)
    over = Window.partitionBy("owner").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    above = owned.select("owner", "stretch", F.coalesce(F.sum("saved").over(over), F.lit(0)).alias("before"))
    within = Window.partitionBy("owner", "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    tree = tree.withColumn("inside", F.coalesce(F.sum("saved").over(within), F.lit(0))).join(above, ["owner", "stretch"]).withColumn("above", F.col("before") + F.col("inside"))

    owners = stored(owned.groupBy(F.col("owner").alias("conv")).agg(F.sum("saved").alias("saved"), F.max("leaf").alias("leaf")))
    sizes = blocks.groupBy("conv").agg(F.count("*").alias("blocks"))
    members = looked_up(blocks.select("conv", "k", "e1", "e2"), owners.join(sizes, "conv"), ["conv"], "blocks", blocks.count())
    measures = members.groupBy("k", "e1", "e2").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("below"))
    measured = turn.select("k", "e1", "e2", *NODE).join(measures, ["k", "e1", "e2"]).groupBy(*NODE).agg(F.sum("leaves").alias("n_leaves"), F.sum("below").alias("below"))

    ends = blocks.where("last = depth").select(F.col("last").alias("pos"), F.col("e1").alias("p1"), F.col("e2").alias("p2"), "conv")
    zero = [F.lit(0).cast("long").alias(c) for c in NODE]
    digests = stored(end_digests(ends.unionByName(convs.where("depth = 0").select(*zero, "conv"))))

    total = owners.agg(F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"), F.coalesce(F.sum("saved"), F.lit(0)).alias("below")).first()
    root = convs.agg(F.count("*").alias("n"), F.min("conv").alias("owner")).where("n > 0")
    first = children.where("pos = 0").select("n_children").first()
    of_root = {"n_children": first.n_children if first else 0, "n_leaves": total.n_leaves if first else 1, "saved_tokens": total.below}
    root = root.select(*zero, "owner", F.lit(None).cast("long").alias("parent_conv_id"), "n", *[F.lit(x).cast("long").alias(c) for c, x in of_root.items()])

    n_nodes = nodes.count()
    parents = nodes.select(*NODE, "owner").unionByName(root.select(*NODE, "owner")).join(children, NODE).select(F.col("pos").alias("above_pos"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("owner").alias("parent_conv_id"), F.col("n_children").alias("rows"))
    below = tree.join(measured, NODE).select(*NODE, "q1", "q2", (F.col("pos") - 1).alias("above_pos"), "owner", "n", "n_children", "n_leaves", (F.col("below") - F.col("above")).alias("saved_tokens"))
    under = looked_up(stored(below), stored(parents), ["above_pos", "q1", "q2"], "rows", n_nodes).select(*NODE, "owner", "parent_conv_id", "n", "n_children", "n_leaves", "saved_tokens")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return under.unionByName(root).join(digests, NODE, "left").select(F.col("owner").alias("conv_id"), F.col("pos").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", nothing).alias("ends_sha256"))
