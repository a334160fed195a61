"""Footage catalogue: clips from file listings, gaps, neighbours, audio, problems."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rushes.functions import timecode as tc


def footage_files(files: DataFrame) -> DataFrame:
    """folder, name, path of DNG files without sidecars."""
    name = F.substring_index("path", "/", -1)
    return files.select("path", F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)").alias("folder"), name.alias("name")).where(~F.col("name").startswith("._") & (F.lower(F.substring_index("name", ".", -1)) == "dng"))


def sequence_template(footage: DataFrame) -> DataFrame:
    """clip folder, first and last path, and the last digit run of the first path (from 0) with its length."""
    ends = footage.groupBy("folder").agg(F.min("path").alias("first_path"), F.max("path").alias("last_path"))
    digits = F.regexp_extract("first_path", r"([0-9]+)[^0-9]*$", 1)
    tail = F.length(F.regexp_extract("first_path", r"[0-9]+([^0-9]*)$", 1))
    return ends.select("folder", "first_path", "last_path", (F.length("first_path") - tail - F.length(digits)).cast("long").alias("field_pos"), F.length(digits).cast("long").alias("field_len"))


def frame_numbers(footage: DataFrame, templates: DataFrame) -> DataFrame:
    """Each path's number at the template's field; null where it is no number."""
    return footage.join(templates.select("folder", "field_pos", "field_len"), "folder").select("path", F.expr("try_cast(substring(path, cast(field_pos as int) + 1, cast(field_len as int)) as bigint)").alias("frame"))


def frame_paths(frames: DataFrame, templates: DataFrame) -> DataFrame:
    """folder, frame, path: the first path with the frame's number, filled up with zeros, written over its field.

    A longer number runs over what follows the field, as far as the path goes. frames: folder, frame.
    """
    number = F.lpad(F.col("frame").cast("string"), F.greatest(F.col("field_len").cast("int"), F.length(F.col("frame").cast("string"))), F.lit("0"))
    path = F.overlay("first_path", number, (F.col("field_pos") + 1).cast("int"))
    return frames.join(templates.select("folder", "first_path", "field_pos", "field_len"), "folder").select("folder", "frame", path.alias("path"))


def clip_durations(frames: DataFrame) -> DataFrame:
    return frames.groupBy("clip").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame")).withColumn("duration", F.col("last_frame") - F.col("first_frame") + 1)


def frame_gaps(frames: DataFrame) -> DataFrame:
    """Runs of absent frames between frames that are there."""
    before = F.lag("frame").over(Window.partitionBy("clip").orderBy("frame"))
    return frames.withColumn("before", before).where("frame - before > 1").select("clip", (F.col("before") + 1).alias("gap_start"), (F.col("frame") - 1).alias("gap_end"), (F.col("frame") - F.col("before") - 1).alias("n_missing"))


def adjacent_clips(folders: DataFrame) -> DataFrame:
    """Neighbour clips in the same parent folder, by path."""
    order = Window.partitionBy("parent").orderBy("folder")
    parent = F.expr("substring(folder, 1, length(folder) - length(substring_index(folder, '/', -1)) - 1)")
    return folders.select("folder").distinct().withColumn("parent", parent).select("folder", F.lag("folder").over(order).alias("prev_clip"), F.lead("folder").over(order).alias("next_clip"))


def clips_with_footage(folders: DataFrame, footage: DataFrame) -> DataFrame:
    return folders.join(footage, "folder", "left_semi")


def audio_for_clips(folders: DataFrame, files: DataFrame) -> DataFrame:
    """The default-named sound file alone if there is one, else all of the folder's."""
    parts = files.where(F.lower(F.substring_index("path", ".", -1)) == "wav").select("path", F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)").alias("folder"))
    named = parts.withColumn("is_default", (F.substring_index("path", "/", -1) == F.concat(F.substring_index("folder", "/", -1), F.lit(".wav"))).cast("int"))
    chosen = named.withColumn("has", F.max("is_default").over(Window.partitionBy("folder"))).where("is_default = has")
    return folders.join(chosen, "folder", "left").select("folder", F.col("path").alias("wav_path"), F.when(F.col("path").isNull(), "none").when(F.col("has") == 1, "default").otherwise("all").alias("rule"))


def missing_frames(frames: DataFrame) -> DataFrame:
    expected = clip_durations(frames).select("clip", F.explode(F.sequence("first_frame", "last_frame")).alias("frame"))
    return expected.join(frames, ["clip", "frame"], "left_anti")


def duplicate_frames(frames: DataFrame) -> DataFrame:
    return frames.groupBy("clip", "frame").agg(F.count("*").alias("n")).where("n > 1")


def sequence_problems(footage: DataFrame) -> DataFrame:
    """Folders whose file names have several field widths or prefixes, or no digits at all where the folder has: the number would be read from the folder's name."""
    digits = F.regexp_extract("name", r"([0-9]+)[^0-9]*$", 1)
    prefix = F.regexp_extract("name", r"^(.*?)[0-9]+[^0-9]*$", 1)
    in_folder = F.col("folder").rlike("[0-9]") & (F.max(F.length(digits)) == 0)
    found = footage.groupBy("folder").agg(F.count_distinct(F.length(digits)).alias("n_widths"), F.count_distinct(prefix).alias("n_prefixes"), in_folder.alias("digits_in_folder_only"))
    return found.where("n_widths > 1 or n_prefixes > 1 or digits_in_folder_only")


def resolve_inputs(paths: DataFrame) -> DataFrame:
    """batch, clip: a folder is a clip; of files, the first DNG's folder. paths: batch, ordinal, path, is_dir."""
    usable = paths.where(F.col("is_dir") | (F.lower(F.substring_index("path", ".", -1)) == "dng"))
    parent = F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)")
    return usable.withColumn("clip", F.when(F.col("is_dir"), F.col("path")).otherwise(parent)).groupBy("batch").agg(F.min_by("clip", "ordinal").alias("clip"))


def with_frame_timecodes(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """clip, frame, timecode: the frame's own number where there is one, else counted from the clip's start.

    frames: clip, frame, tag_frame (nullable). clips: clip, rate_num, rate_den, first_frame, start (frames),
    and is_drop, the start timecode's flag, if there is such a column.
    """
    joined = frames.join(clips, "clip")
    joined = joined.withColumns(tc.rate_columns(flag=F.col("is_drop") if "is_drop" in joined.columns else None)).withColumn("n", F.coalesce("tag_frame", F.col("frame") - F.col("first_frame") + F.col("start")))
    return joined.withColumn("n", tc.renumbered("n")).select("clip", "frame", tc.timecode_at_rate("n").alias("timecode"))


def timecode_breaks(frames: DataFrame) -> DataFrame:
    """Where the carried number steps otherwise than the frame. frames: clip, frame, tc_frame."""
    order = Window.partitionBy("clip").orderBy("frame")
    step = lambda c: F.col(c) - F.lag(c).over(order)
    return frames.select("clip", "frame", step("tc_frame").alias("tc_step"), step("frame").alias("frame_step")).where("tc_step <> frame_step")


def duration_labels(clips: DataFrame) -> DataFrame:
    """clip, label: the length as timecode without hours. clips: clip, duration, rate_num, rate_den, and is_drop if there is such a column."""
    return clips.withColumns(tc.rate_columns(flag=F.col("is_drop") if "is_drop" in clips.columns else None)).withColumn("n", tc.renumbered("duration")).select("clip", tc.timecode_at_rate("n", hours=False).alias("label"))
