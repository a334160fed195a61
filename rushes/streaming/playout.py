"""Playout audits: quality by time window, sessions, request dedupe; batch and streaming take the same functions."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def playout_quality(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per clip, kind and window, tumbling or sliding. On a stream, give events a watermark first."""
    return events.groupBy("clip", F.window("ts", size, slide).alias("w"), "kind").agg(F.count("*").alias("n")).select("clip", F.col("w.start").alias("window_start"), "kind", "n")


def play_sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Runs of a clip's events with no longer gap. The streaming twin groups by session_window."""
    order = Window.partitionBy("clip").orderBy("ts", "event_id")
    new = F.coalesce((F.col("ts") > F.lag("ts").over(order) + F.expr(f"interval {gap_minutes} minutes")).cast("int"), F.lit(1))
    numbered = events.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("clip", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_events"))


def stream_sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    session = F.session_window("ts", f"{gap_minutes} minutes")
    return events.groupBy("clip", session.alias("w")).agg(F.count("*").alias("n_events")).select("clip", F.col("w.start").alias("started"), "n_events")


def dedupe_requests(requests: DataFrame) -> DataFrame:
    """One request for each clip and frame; on a stream, within its watermark."""
    if requests.isStreaming:
        return requests.dropDuplicatesWithinWatermark(["clip", "frame"])
    return requests.dropDuplicates(["clip", "frame"])


VELOCITIES = (-10, -5, -2, -1, 1, 2, 5, 10)


def playout_schedule(clips: DataFrame, velocities=VELOCITIES, preroll: int = 6) -> DataFrame:
    """The frames shown at each velocity: every so many from the end that play starts at, and the other end.

    clips: clip, first_frame, last_frame, rate_num, rate_den (23.976 where null). A step is one frame's
    time; a frame is asked for at request_s and displayed preroll steps later.
    """
    clips = clips.withColumn("velocity", F.explode(F.array(*[F.lit(v) for v in velocities])))
    start = F.when(F.col("velocity") > 0, F.col("first_frame")).otherwise(F.col("last_frame"))
    end = F.when(F.col("velocity") > 0, F.col("last_frame")).otherwise(F.col("first_frame"))
    shown = F.array_distinct(F.concat(F.sequence(start, end, F.col("velocity").cast("long")), F.array(end)))
    step = F.coalesce(F.col("rate_den"), F.lit(1001)) / F.coalesce(F.col("rate_num"), F.lit(24000)).cast("double")
    rows = clips.select("clip", "velocity", step.alias("step"), F.posexplode(shown).alias("i", "frame"))
    return rows.select("clip", "velocity", F.col("i").cast("long").alias("i"), "frame", (F.col("i") * F.col("step")).alias("request_s"), ((F.col("i") + preroll) * F.col("step")).alias("display_s"))


REACH = 128  # frames a block: the first pass looks at a tick's own block and the one before
FAN = 16  # nodes under one of the next level


def ready_tree(have: DataFrame, reach: int, levels: int) -> DataFrame:
    """clip, level, node, first: when the first frame is ready in each block of reach frames (level 0), and in each FAN nodes of the level below."""
    level = have.groupBy("clip", F.floor(F.col("_ready") / reach).cast("long").alias("node")).agg(F.min("ready_ts").alias("first"))
    out = level.withColumn("level", F.lit(0))
    for k in range(1, levels):
        level = level.groupBy("clip", F.floor(F.col("node") / FAN).cast("long").alias("node")).agg(F.min("first").alias("first"))
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out


def levels_of(blocks: int) -> int:
    """Levels after which at most FAN nodes are left of so many blocks."""
    levels = 1
    while blocks > FAN:
        blocks, levels = -(-blocks // FAN) + 1, levels + 1
    return levels


def beside(ticks: DataFrame, reach: int, levels: int, sign: int, ends: tuple[int, int]) -> DataFrame:
    """Each tick with the nodes that lie behind its block in play direction: on each level the siblings of its own node, on the topmost all up to the table's end.

    Nearer nodes have lower levels; a tick has fewer than FAN on each, and FAN + 1 at most on the topmost.
    """
    node = [F.floor(F.col("frame") / reach / FAN**k).cast("long") for k in range(levels)]
    at_level = lambda k: lambda n: F.struct(F.lit(k).alias("level"), n.alias("node"))
    places = []
    for k in range(levels):
        if k + 1 < levels:
            edge = F.floor(node[k] / FAN).cast("long") * FAN + (0 if sign > 0 else FAN - 1)
        else:
            edge = F.lit((ends[0] if sign > 0 else ends[1]) // FAN**k).cast("long")
        # nothing where the own node is the edge already or lies beyond it
        inner = node[k] - sign
        near_end = F.least(inner, F.lit(ends[1] // FAN**k).cast("long")) if sign > 0 else F.greatest(inner, F.lit(ends[0] // FAN**k).cast("long"))
        some = (near_end - edge) * sign >= 0
        places.append(F.when(some, F.transform(F.sequence(edge, near_end), at_level(k))).otherwise(F.array().cast("array<struct<level: int, node: bigint>>")))
    return ticks.withColumn("_at", F.explode(F.concat(*places))).select(*ticks.columns, "_at.level", "_at.node")


def nearest_ready(ticks: DataFrame, ready: DataFrame, forward: bool = True, reach: int = REACH) -> DataFrame:
    """Ticks with shown_frame: the ready frame nearest to the one asked for, not beyond it in play direction.

    ticks: clip, event_id, frame, tick_ts. ready: clip, frame, ready_ts. A frame counts if ready by the
    tick, at any distance. Both sides meet in blocks of reach frames, so a long clip is spread over
    many keys. Ticks that find none there look further by a tree of when the first frame is ready in
    each block: the nearest node on any level with one ready in time, then down by FAN children a
    step to a block, and to its frames. A tick meets no more than FAN nodes on each level on
    its way up and on its way down.
    """
    block = lambda c: F.floor(F.col(c) / reach).cast("long")
    sign = 1 if forward else -1
    # only the first time a frame is ready matters
    have = ready.groupBy("clip", F.col("frame").alias("_ready")).agg(F.min("ready_ts").alias("ready_ts"))
    probe = ticks.withColumn("_block", F.explode(F.array(block("frame"), block("frame") - sign)))
    counts = lambda frame, ts: (ts <= F.col("tick_ts")) & ((F.col("frame") - frame) * sign >= 0)
    met = probe.join(have.withColumn("_block", block("_ready")), ["clip", "_block"]).where(counts(F.col("_ready"), F.col("ready_ts")))
    most = F.max if forward else F.min
    best = met.groupBy("clip", "event_id").agg(most("_ready").alias("shown_frame"))

    ends = have.agg(F.min(block("_ready")), F.max(block("_ready"))).first()
    if ends[0] is None:
        return ticks.join(best, ["clip", "event_id"], "left")
    levels = levels_of(ends[1] - ends[0] + 1)
    tree = ready_tree(have, reach, levels)
    far = ticks.join(best, ["clip", "event_id"], "left_anti").select("clip", "event_id", "frame", "tick_ts")
    near_first = F.struct("level", (F.col("node") * -sign).alias("key"), "node", "frame", "tick_ts")
    in_time = beside(far, reach, levels, sign, (ends[0], ends[1])).join(tree, ["clip", "level", "node"]).where("first <= tick_ts")
    found = in_time.groupBy("clip", "event_id").agg(F.min(near_first).alias("_n")).select("clip", "event_id", "_n.level", "_n.node", "_n.frame", "_n.tick_ts")
    for k in range(levels - 1, 0, -1):
        under = found.where(F.col("level") == k).withColumn("node", F.explode(F.sequence(F.col("node") * FAN, F.col("node") * FAN + FAN - 1))).withColumn("level", F.col("level") - 1)
        down = under.join(tree, ["clip", "level", "node"]).where("first <= tick_ts").groupBy("clip", "event_id").agg(F.min(near_first).alias("_n")).select("clip", "event_id", "_n.level", "_n.node", "_n.frame", "_n.tick_ts")
        found = found.where(F.col("level") < k).unionByName(down)
    last = found.join(have.withColumn("node", block("_ready")), ["clip", "node"]).where(counts(F.col("_ready"), F.col("ready_ts")))
    best = best.union(last.groupBy("clip", "event_id").agg(most("_ready").alias("shown_frame")))
    return ticks.join(best, ["clip", "event_id"], "left")


def classify_ticks(shown: DataFrame, present: DataFrame) -> DataFrame:
    """Adds kind: missing where the frame asked for is no file, displayed where it is shown, else skipped."""
    known = present.select("clip", "frame").distinct().withColumn("_there", F.lit(True))
    kind = F.when(F.col("_there").isNull(), "missing").when(F.col("shown_frame") == F.col("frame"), "displayed").otherwise("skipped")
    return shown.join(known, ["clip", "frame"], "left").withColumn("kind", kind).drop("_there")


def audio_offsets(ticks: DataFrame, clips: DataFrame) -> DataFrame:
    """clip, frame, position (seconds into the sound), plays. clips: clip, first_frame, rate_num, rate_den, audio_seconds."""
    rate = F.coalesce(F.col("rate_num"), F.lit(24000)) / F.coalesce(F.col("rate_den"), F.lit(1001))
    at = (F.col("frame") - F.col("first_frame")) / rate
    return ticks.join(clips, "clip").select("clip", "frame", at.alias("position"), (at < F.col("audio_seconds")).alias("plays"))
