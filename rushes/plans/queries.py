"""Registered queries of the footage operators and their DuckDB SQL."""

from pyspark.sql import functions as F

from rushes.functions import timecode as tc
from rushes.operators import catalog, colour, develop, history, metadata
from rushes.sources import footage as src
from rushes.sources import headers
from rushes.streaming import playout

WITH_FRAMES = """frames as (select distinct l_orderkey as clip, cast(l_linenumber as bigint) as frame from lineitem),
clips as (select clip, '/media/reel'||lpad(cast(clip%20 as varchar),2,'0')||'/C'||lpad(cast(clip as varchar),6,'0') as folder,
  'C'||lpad(cast(clip as varchar),6,'0') as name, min(frame) as first_frame, max(frame) as last_frame from frames group by clip)"""
WITH_FILES = WITH_FRAMES + """,
files as (select c.folder||'/'||c.name||'_'||lpad(cast(f.frame as varchar),6,'0')||'.dng' as path from frames f join clips c on f.clip=c.clip
  union all select folder||'/._'||name||'_000001.dng' from clips where clip%7=0
  union all select folder||'/'||name||'.wav' from clips where clip%3=0
  union all select folder||'/mic1.wav' from clips where clip%4=0
  union all select folder||'/mic2.wav' from clips where clip%4=0),
parts as (select path, regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, regexp_extract(path, '([^/]*)$', 1) as name from files),
footage as (select * from parts where name not like '.\\_%' escape '\\' and lower(name) like '%.dng'),
template as (select *, length(first_path) - length(regexp_extract(first_path, '([0-9]+[^0-9]*)$', 1)) as field_pos,
  length(regexp_extract(first_path, '([0-9]+)[^0-9]*$', 1)) as field_len from (select folder, min(path) as first_path, max(path) as last_path from footage group by folder))"""
WITH_META = f"clip_meta as ({src.CLIP_META})"
WITH_TAGS = f"tag_meta as ({src.TAG_META.format(text='varchar')})"
WITH_RGB = "rgb as (select l_orderkey as clip, cast(l_linenumber as bigint) as frame, l_partkey as px, l_quantity/50 as r, abs(l_discount)*10 as g, abs(l_tax)*12.5 as b from lineitem)"
WITH_HISTORY = """history as (select user_id, '/media/C'||lpad(cast(event_id%37 as varchar),6,'0') as path, case when event_id%50=0 then '' else 'sequence' end as type, ts as opened, event_id from events)"""
WITH_PLAYOUT = "playout as (select user_id as clip, ts, event_id, case event_type when 'purchase' then 'skipped' when 'error' then 'missing' else 'displayed' end as kind from events)"


SUPPORT = WITH_TAGS + """, sized as (select *, n_segments>0 and tile_w is not null as is_tiled, case when tile_w is not null and n_segments>0 then ceil(width/256.0)*256*ceil(height/256.0)*256 else width*height end::bigint as area, case when n_segments=0 then 0 else n_segments-n_lost end as n_counts from tag_meta),
seg as (select clip, i, bits, floor(area*bits/8)::bigint as size, segment_bytes - case when i=n_counts-1 then cut_bytes else 0 end as n from (select *, unnest(range(n_counts)) as i from sized)),
run as (select *, coalesce(sum(n) over (partition by clip order by i rows between unbounded preceding and 1 preceding), 0) as before from seg),
total as (select clip, sum(n) as total, sum(floor(greatest(0, least(n, size-before))*16/bits)) as unpacked from run group by clip),
judged as (select s.clip, case when pattern=4 then 'UnsupportedPattern' when n_segments=0 or n_counts<>n_segments then 'BadImageData' when compression not in (1,7) then 'NotImplemented'
  when compression=1 and bits not in (8,10,12,14,16) then 'NotImplemented' when compression=1 and bits in (8,16) and total<floor(area*bits/8) then 'BadImageData'
  when compression=1 and bits in (10,12,14) and unpacked<>area*2 then 'BadImageData' when compression=7 and n_segments=1 and is_tiled and area<>65536 then 'BadImageData' else 'None' end as support
  from sized s left join total using (clip))"""


def _footage(spark, d):
    return catalog.footage_files(src.files(spark, d))


def _playout(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "skipped").when(F.col("event_type") == "error", "missing").otherwise("displayed")
    return src.table(spark, d, "events").select(F.col("user_id").alias("clip"), "ts", "event_id", kind.alias("kind"))


def _headers(spark, d):
    """Tags read back from header files that hold each clip's."""
    clip = F.regexp_extract("path", r"C(\d+)\.dng", 1).cast("long").alias("clip")
    return headers.ingest_headers(src.header_files(spark, d).select("path", "content")).select(clip, "*")


def header_tags(spark, d):
    at = lambda c, i: F.get(c, F.lit(i)).alias(f"{c}{i}")
    one = ["status", "width", "height", "bits", "compression", "orientation", "tile_w", "tile_h", "black_level", "white_level", "baseline_exposure", "model", "rate_num", "rate_den", "illuminant1", "tiled"]
    listed = [at(c, i) for c, n in {"timecode": 4, "crop_origin": 2, "crop_size": 2, "active_area": 4, "scale": 2, "neutral": 3}.items() for i in range(n)]
    return _headers(spark, d).select("clip", *one, *listed, metadata.cfa_pattern(F.col("cfa")).alias("pattern"), F.size("offsets").cast("long").alias("n_offsets"), F.size("byte_counts").cast("long").alias("n_counts"), F.round(F.aggregate("color_matrix1", F.lit(0.0), lambda a, x: a + x), 9).alias("matrix_sum"), F.greatest(F.size("linearisation"), F.lit(0)).cast("long").alias("n_curve"), (F.col("bytes_read") <= 16384).alias("few_bytes"))


def gap_report(spark, d):
    """Every gap with its first and last timecode at 24 frames a second."""
    gaps = catalog.frame_gaps(src.frames(spark, d))
    at = lambda c: tc.label(tc.parts(F.col(c), 24), drop=False)
    return gaps.select("clip", "gap_start", "gap_end", "n_missing", at("gap_start").alias("start_timecode"), at("gap_end").alias("end_timecode"))


def _numbers(spark, d):
    """Frame numbers up to several hours, from the order lines."""
    return src.table(spark, d, "lineitem").select((F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("n")).distinct()


def _timecode(drop, rate):
    def query(spark, d):
        n = _numbers(spark, d)
        n = n.withColumn("m", tc.drop_frames("n", drop) if drop else F.col("n"))
        p = tc.parts(F.col("m"), rate, wrap=bool(drop))
        return n.select("n", tc.label(p, bool(drop)).alias("timecode"), tc.frames_of(p, drop, rate).alias("back"))

    return query


def _timecode_sql(drop, rate):
    m = f"n + {9 * drop} * (n // {8991 * drop}) + {drop} * ((n % {8991 * drop} - {drop}) // {8991 * drop // 10})" if drop else "n"
    hour = "(m // (3600*{r})) % 24" if drop else "m // (3600*{r})"
    hour = hour.format(r=rate)
    two = lambda e: f"(case when {e}<100 then lpad(cast({e} as varchar),2,'0') else cast({e} as varchar) end)"
    s, mi = f"((m // {rate}) % 60)", f"((m // (60*{rate})) % 60)"
    # the round trip gives n again below 24 hours
    wrap = 24 * 6 * 8991 * drop if drop else 0
    back = f"n % {wrap}" if drop else "n"
    return f"with a as (select distinct l_orderkey*7+l_linenumber as n from lineitem), b as (select n, {m} as m from a) select n, {two(hour)}||':'||{two(mi)}||':'||{two(s)}||'{';' if drop else ':'}'||{two(f'm % {rate}')} as timecode, {back} as back from b"


def smpte(spark, d):
    flags = {"tc1": 128, "tc2": 128, "tc3": 192}
    set_ = {c: F.col(c) + F.when(F.col("clip") % 3 == i, v).otherwise(0) for i, (c, v) in enumerate(flags.items())}
    cols = tc.smpte_decode(*[F.col(f"tc{i}") for i in range(4)])
    return src.clip_meta(spark, d).withColumns(set_).select("clip", *[c.alias(n) for n, c in cols.items()])


def seek(spark, d):
    return catalog.clip_durations(src.frames(spark, d)).select("clip", F.bround(F.col("first_frame") + (F.col("last_frame") - F.col("first_frame")) * 0.5).cast("long").alias("seek_frame"), F.when(F.col("first_frame") == F.col("last_frame"), 1.0).otherwise((F.col("last_frame") - 1) / F.greatest(F.lit(1), F.col("last_frame") - F.col("first_frame"))).alias("playhead"))


def _rgb6(df, *names):
    return df.groupBy("clip", "frame", "px").agg(*[F.round(F.sum(c), 6).alias(c) for c in names or ("r", "g", "b")])


def _mean(df):
    """Per clip, the means of the developed channels."""
    return df.groupBy("clip").agg(*[F.round(F.avg(c), 6).alias(c) for c in "rgb"])


def _plain_mean(df):
    """The same in full: a mean near the border of two roundings can go either way."""
    return df.groupBy("clip").agg(*[F.avg(c).alias(c) for c in "rgb"])


WHITE = (2.0, 1.0, 1.6)
MATRIX = [1.2, -0.15, -0.05, -0.1, 1.15, -0.05, 0.0, -0.2, 1.2]
PLAIN_MEAN_SQL = "select clip, avg(r) as r, avg(g) as g, avg(b) as b from x group by clip"
MEAN_SQL = "select clip, round(avg(r),6) as r, round(avg(g),6) as g, round(avg(b),6) as b from x group by clip"
SMOOTH = lambda a, b, x: f"(least(1.0,greatest(0.0,(({x})-{a})/({b}-{a})))**2*(3-2*least(1.0,greatest(0.0,(({x})-{a})/({b}-{a})))))"
CURVES = ("Rec709", "sRGB", "LogC3", "Log3G10", "FilmGen5")


def gamma_curves(spark, d):
    rgb = src.rgb(spark, d)
    return rgb.select("clip", *[develop.encode_gamma(F.col("r"), s).alias(s) for s in CURVES]).groupBy("clip").agg(*[F.round(F.avg(s), 6).alias(s.lower()) for s in CURVES])


def cct(spark, d):
    return colour.with_cct(src.profiles(spark, d), "wx", "wy").select("clip", F.col("cct").cast("long").alias("kelvin"))


def white_xyz(spark, d):
    v = colour.xy_to_xyz(F.col("wx"), F.col("wy"))
    return src.profiles(spark, d).select("clip", v.alias("v")).select("clip", *[F.round(F.col("v")[i], 9).alias(c) for i, c in enumerate("xyz")])


def next_frames(spark, d):
    """The paths of the first frame that each clip lacks at its end, and of one whose number is too long for the field."""
    templates = catalog.sequence_template(_footage(spark, d))
    after = src.clips(spark, d).select("folder", F.explode(F.array(F.col("last_frame") + 1, F.col("last_frame") + 12345670)).alias("frame"))
    return catalog.frame_paths(after, templates)


def problems(spark, d):
    still = src.clips(spark, d).where("clip % 60 = 0").select(F.concat(F.regexp_replace("folder", "/C", "/still C"), F.lit("/frame.dng")).alias("path"))
    return catalog.sequence_problems(catalog.footage_files(src.files(spark, d, mixed=True).unionByName(still)))


def mono(spark, d):
    values = src.rgb(spark, d).select("clip", F.col("g").alias("v"))
    return develop.tone_map_mono(values).groupBy("clip").agg(F.round(F.avg("v"), 6).alias("v"))


def rolled_off(spark, d):
    """Each level's mean over the clip."""
    rgb = develop.tone_map(src.rgb(spark, d))
    each = [develop.highlight_rolloff(rgb, level).withColumn("level", F.lit(level or "none")) for level in (None, "low", "medium", "high")]
    whole = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
    return whole.groupBy("clip", "level").agg(*[F.avg(c).alias(c) for c in "rgb"])


QUERIES = {
    "a2_footage_files": lambda s, d: _footage(s, d).select("path", "folder", "name"),
    "a3_sequence_template": lambda s, d: catalog.sequence_template(_footage(s, d)),
    "a4_frame_numbers": lambda s, d: catalog.frame_numbers(_footage(s, d), catalog.sequence_template(_footage(s, d))),
    "a5_clip_durations": lambda s, d: catalog.clip_durations(src.frames(s, d)),
    "a6_frame_gaps": gap_report,
    "a7_adjacent_clips": lambda s, d: catalog.adjacent_clips(_footage(s, d)),
    "a8_clips_with_footage": lambda s, d: catalog.clips_with_footage(src.clips(s, d).select("folder"), _footage(s, d)),
    "a9_audio_for_clips": lambda s, d: catalog.audio_for_clips(src.clips(s, d).select("folder"), src.files(s, d)),
    "a10_missing_frames": lambda s, d: catalog.missing_frames(src.frames(s, d)),
    "a11_duplicate_frames": lambda s, d: catalog.duplicate_frames(src.frame_rows(s, d)),
    "a4_frame_paths": next_frames,
    "a12_sequence_problems": problems,
    "b1_ingest_headers": header_tags,
    "b2_tag_defaults": lambda s, d: metadata.with_tag_defaults(_headers(s, d)).select("*", *[F.col("active_area")[i].alias(f"area{i}") for i in range(4)]).drop("active_area"),
    "b4_decoded_depth": lambda s, d: metadata.decoded_depth(src.clip_meta(s, d)),
    "b5_padded_dimensions": lambda s, d: metadata.padded_dimensions(src.clip_meta(s, d)),
    "b5_tile_grid": lambda s, d: metadata.tile_grid(src.clip_meta(s, d)),
    "b6_display_geometry": lambda s, d: metadata.display_geometry(_headers(s, d).select("*", F.get("crop_size", F.lit(0)).alias("crop_w"), F.get("crop_size", F.lit(1)).alias("crop_h"))),
    "b7_support_audit": lambda s, d: metadata.support_audit(_headers(s, d)),
    "b7_support_status": lambda s, d: metadata.support_status(_headers(s, d)).select("clip", "support"),
    "b8_metadata_drift": lambda s, d: metadata.metadata_drift(src.frame_meta(s, d)),
    "b11_storage_report": lambda s, d: metadata.storage_report(src.segments(s, d), src.clip_meta(s, d)),
    "c1_smpte_decode": smpte,
    "c2_timecode_25": _timecode(0, 25),
    "c3_timecode_2997": _timecode(2, 30),
    "c3_timecode_5994": _timecode(4, 60),
    "c10_seek": seek,
    "d3_levels": lambda s, d: develop.levels(src.pixels(s, d), 4096.0, 61440.0).groupBy("frame").agg(F.round(F.avg("level"), 6).alias("level")),
    "d9_highlight_correct": lambda s, d: _mean(develop.highlight_correct(src.rgb(s, d), WHITE)),
    "d10_to_display": lambda s, d: _mean(develop.to_display(develop.exposure(src.rgb(s, d), 0.5), MATRIX)),
    "d11_tone_map": lambda s, d: _mean(develop.highlight_rolloff(develop.tone_map(src.rgb(s, d)))),
    "d11_tone_map_mono": mono,
    "d11_rolloff_levels": rolled_off,
    "d12_gamut_compress": lambda s, d: _plain_mean(develop.gamut_compress(src.rgb(s, d).withColumn("b", F.col("b") - 0.25))),
    "d13_gamma_curves": gamma_curves,
    "d15_clipping_report": lambda s, d: develop.clipping_report(src.rgb(s, d)),
    "d20_quantise": lambda s, d: develop.quantise_8bit(src.rgb(s, d)).groupBy("clip").agg(*[F.sum(f"{c}8").alias(f"{c}8") for c in "rgb"]),
    "f2_dedupe_requests": lambda s, d: playout.dedupe_requests(src.frame_rows(s, d)),
    "f6_playout_quality": lambda s, d: playout.playout_quality(_playout(s, d)),
    "f6_sliding_quality": lambda s, d: playout.playout_quality(_playout(s, d), "1 hour", "20 minutes"),
    "f7_play_sessions": lambda s, d: playout.play_sessions(_playout(s, d)).select("clip", "started", "ended", "n_events"),
    "g1_recent_clips": lambda s, d: history.recent_clips(src.history(s, d)),
    "g2_recent_by_user": lambda s, d: history.recent_clips_by_user(src.history(s, d), 3),
    "g4_favourites": lambda s, d: history.favourite_flags(src.history(s, d).select("path"), src.history(s, d).join(src.table(s, d, "events").where("event_type = 'purchase'").select("event_id"), "event_id")),
    "h2_white_xyz": white_xyz,
    "h3_cct": cct,
}

ORACLES = {
    "a2_footage_files": f"with {WITH_FILES} select path, folder, name from footage",
    "a3_sequence_template": f"with {WITH_FILES} select folder, first_path, last_path, field_pos, field_len from template",
    "a4_frame_numbers": f"with {WITH_FILES} select path, try_cast(substring(path, field_pos+1, field_len) as bigint) as frame from footage join template using (folder)",
    "a4_frame_paths": f"""with {WITH_FILES}, n as (select folder, unnest([last_frame+1, last_frame+12345670]) as frame from clips)
select folder, frame, substring(first_path, 1, field_pos)||repeat('0', greatest(0, field_len-length(frame::varchar)))||frame::varchar||substring(first_path, field_pos+greatest(field_len, length(frame::varchar))+1) as path from n join template using (folder)""",
    "a5_clip_durations": f"with {WITH_FRAMES} select clip, first_frame, last_frame, last_frame-first_frame+1 as duration from clips",
    "a6_frame_gaps": f"""with {WITH_FRAMES}, p as (select clip, frame, lag(frame) over (partition by clip order by frame) as before from frames),
g as (select clip, before+1 as gap_start, frame-1 as gap_end, frame-before-1 as n_missing from p where frame-before>1)
select *, '00:00:'||lpad(cast(gap_start//24 as varchar),2,'0')||':'||lpad(cast(gap_start%24 as varchar),2,'0') as start_timecode,
 '00:00:'||lpad(cast(gap_end//24 as varchar),2,'0')||':'||lpad(cast(gap_end%24 as varchar),2,'0') as end_timecode from g""",
    "a7_adjacent_clips": f"""with {WITH_FILES}, f as (select distinct folder, regexp_extract(folder, '^(.*)/[^/]*$', 1) as parent from footage)
select folder, lag(folder) over w as prev_clip, lead(folder) over w as next_clip from f window w as (partition by parent order by folder)""",
    "a8_clips_with_footage": f"with {WITH_FILES} select folder from clips where folder in (select folder from footage)",
    "a9_audio_for_clips": f"""with {WITH_FILES}, w as (select path, folder, case when name = regexp_extract(folder, '([^/]*)$', 1)||'.wav' then 1 else 0 end as d from parts where lower(name) like '%.wav'),
x as (select *, max(d) over (partition by folder) as has from w)
select c.folder, x.path as wav_path, case when x.path is null then 'none' when has=1 then 'default' else 'all' end as rule from clips c left join x on c.folder=x.folder and d=has""",
    "a10_missing_frames": f"with {WITH_FRAMES}, e as (select clip, unnest(range(first_frame, last_frame+1)) as frame from clips) select clip, frame from e except select clip, frame from frames",
    "a11_duplicate_frames": "select l_orderkey as clip, cast(l_linenumber as bigint) as frame, count(*) as n from lineitem group by all having count(*)>1",
    "a12_sequence_problems": f"""with {WITH_FILES}, m as (select folder, name from footage union all select folder, name||'_'||cast(last_frame+1 as varchar)||'.dng' from clips where clip%50=0 union all select replace(folder, '/C', '/still C'), 'frame.dng' from clips where clip%60=0)
select folder, count(distinct length(regexp_extract(name, '([0-9]+)[^0-9]*$', 1))) as n_widths, count(distinct regexp_extract(name, '^(.*?)[0-9]+[^0-9]*$', 1)) as n_prefixes, max(length(regexp_extract(name, '([0-9]+)[^0-9]*$', 1)))=0 and regexp_matches(folder, '[0-9]') as digits_in_folder_only from m group by folder having n_widths>1 or n_prefixes>1 or digits_in_folder_only""",
    "b1_ingest_headers": f"""with {WITH_TAGS} select clip, 'None' as status, width, height, bits::bigint as bits, compression::bigint as compression, orientation, tile_w::bigint as tile_w, tile_h::bigint as tile_h,
 (case when black_level is null then null when clip%2=1 then black_level+0.5 else black_level end)::double as black_level, white_level::double as white_level,
 baseline_exposure, coalesce(model,'') as model, rate_num::bigint as rate_num, rate_den::bigint as rate_den, 17+clip%2*4 as illuminant1, tile_w is not null and n_segments>0 as tiled,
 tc0 as timecode0, tc1 as timecode1, tc2 as timecode2, tc3 as timecode3, crop_x::bigint as crop_origin0, case when crop_x is not null then 0 end::bigint as crop_origin1, crop_w::bigint as crop_size0, crop_h::bigint as crop_size1,
 area_top::bigint as active_area0, case when area_top is not null then 8 end::bigint as active_area1, case when area_top is not null then height-4 end as active_area2, case when area_top is not null then width-8 end as active_area3,
 scale_num/2.0::double as scale0, case when scale_num is not null then 1.0::double end as scale1, case when clip%4=0 then 1.0::double else 0.5 end as neutral0, 1.0::double as neutral1, case when clip%4=0 then 2.0::double else 0.625 end as neutral2,
 case pattern when -1 then 'None' when 0 then 'RGGB' when 1 then 'BGGR' when 2 then 'GRBG' when 3 then 'GBRG' else 'Unknown' end as pattern,
 n_segments::bigint as n_offsets, case when n_segments=0 then 0 else n_segments-n_lost end::bigint as n_counts, round((clip%10+70)/100.0::double+0.9::double,9) as matrix_sum, case when clip%2=0 then greatest(1,clip%16) else 0 end::bigint as n_curve, true as few_bytes from tag_meta""",
    "b2_tag_defaults": f"""with {WITH_TAGS} select clip, coalesce(black_level,0)::bigint as black_level, coalesce(white_level, (1::bigint << bits)-1)::bigint as white_level, coalesce(baseline_exposure,0.0)::double as exposure, coalesce(rate_num,24000)::bigint as rate_num, coalesce(rate_den,1001)::bigint as rate_den,
 coalesce(scale_num/2.0::double, 1.0) as pixel_w, 1.0::double as pixel_h, coalesce(area_top,0)::bigint as area0, case when area_top is null then 0 else 8 end::bigint as area1, case when area_top is null then height else height-4 end::bigint as area2, case when area_top is null then width else width-8 end::bigint as area3, coalesce(model,'') as model from tag_meta""",
    "b4_decoded_depth": f"with {WITH_META} select clip, (case when compression=1 then case when bits>8 then 16 else 8 end when compression=7 then 16 else bits end)::bigint as decoded_bits, floor(width*height*bits/8)::bigint as packed_bytes from clip_meta",
    "b5_padded_dimensions": f"with {WITH_META} select clip, coalesce(ceil(width/tile_w)*tile_w, width)::bigint as padded_w, coalesce(ceil(height/tile_h)*tile_h, height)::bigint as padded_h from clip_meta",
    "b5_tile_grid": f"""with {WITH_META}, t as (select *, unnest(range(cast(ceil(width/256.0)*ceil(height/256.0) as bigint))) as tile, cast(ceil(width/256.0) as bigint) as across from clip_meta where tile_w is not null),
 p as (select *, tile%across*256 as x, tile//across*256 as y from t) select clip, tile, x, y, least(256, width-x) as shown_w, least(256, height-y) as shown_h, tile*65536 as first_sample from p""",
    "b6_display_geometry": f"""with {WITH_TAGS}, g as (select clip, orientation, coalesce(crop_w,width)::bigint as w, coalesce(crop_h,height)::bigint as h, floor(coalesce(crop_w,width)*coalesce(scale_num/2.0::double,1))::bigint as n from tag_meta)
 select clip, case when orientation>=5 then h else w end as display_w, case when orientation>=5 then w else h end as display_h, case when orientation>=5 then h else n end as aspect_num, case when orientation>=5 then n else h end as aspect_den from g""",
    "b7_support_audit": f"with {SUPPORT} select support as status, count(*) as n from judged group by 1",
    "b7_support_status": f"with {SUPPORT} select clip, support from judged",
    "b8_metadata_drift": f"""with {WITH_FRAMES}, {WITH_META}, m as (select f.clip, case when (f.clip*7+f.frame)%97=0 then 12 else bits end as bits, width, height, compression from frames f join clip_meta c using (clip)),
u as (select clip, 'bits' as field, bits::bigint as value from m union all select clip, 'width', width from m union all select clip, 'height', height from m union all select clip, 'compression', compression from m)
select clip, field, count(distinct value) as n_values from u group by clip, field having n_values>1""",
    "b11_storage_report": f"""with {WITH_META}, s as (select l_orderkey as clip, count(*) as n_segments, sum(floor(l_extendedprice)::bigint)::bigint as packed_bytes, max(floor(l_extendedprice)::bigint) as largest, count(distinct l_linenumber) as n_frames from lineitem group by 1)
 select s.clip, n_segments, packed_bytes, largest, packed_bytes/(n_frames*(coalesce(ceil(width/tile_w)*tile_w, width)*coalesce(ceil(height/tile_h)*tile_h, height)*(case when compression=1 then case when bits>8 then 16 else 8 end when compression=7 then 16 else bits end)/8)::double) as ratio from s left join clip_meta using (clip)""",
    "c1_smpte_decode": f"with {WITH_META} select clip, ((tc0&15)+((tc0>>4)&3)*10)::bigint as ff, ((tc1&15)+((tc1>>4)&7)*10)::bigint as ss, ((tc2&15)+((tc2>>4)&7)*10)::bigint as mm, ((tc3&15)+((tc3>>4)&3)*10)::bigint as hh, ((tc0>>6)&1)=1 as is_drop, clip%3=0 as flag1, clip%3=1 as flag2, clip%3=2 as flag3, clip%3=2 as flag4 from clip_meta",
    "c2_timecode_25": _timecode_sql(0, 25),
    "c3_timecode_2997": _timecode_sql(2, 30),
    "c3_timecode_5994": _timecode_sql(4, 60),
    "c10_seek": f"with {WITH_FRAMES} select clip, round_even(first_frame+(last_frame-first_frame)*0.5::double,0)::bigint as seek_frame, case when first_frame=last_frame then 1.0::double else (last_frame-1)/greatest(1,last_frame-first_frame) end as playhead from clips",
    "d3_levels": "with e as (select vec_id as frame, unnest(embedding) as e from embeddings) select frame, round(avg((cast(floor(least(greatest(cast(e as double)+cast(0.6 as double),cast(0 as double)),cast(1 as double))*65535) as bigint)-4096.0::double)/(61440-4096)::double),6) as level from e group by frame",
    "d9_highlight_correct": f"with {WITH_RGB}, y as (select *, {SMOOTH('(0.99*2.0::double**(-0.5))', '0.99::double', 'greatest(r,g,b)')} as t from rgb), x as (select clip, r+(2.0-r)*t as r, g+(1.0-g)*t as g, b+(1.6-b)*t as b from y) {MEAN_SQL}",
    "d10_to_display": f"with {WITH_RGB}, e as (select clip, r*2.0::double**0.5 as r, g*2.0::double**0.5 as g, b*2.0::double**0.5 as b from rgb), x as (select clip, greatest(0.0,r*1.2-g*0.15-b*0.05) as r, greatest(0.0,g*1.15-r*0.1-b*0.05) as g, greatest(0.0,b*1.2-g*0.2) as b from e) {MEAN_SQL}",
    "d11_tone_map": f"""with {WITH_RGB}, u as (select clip, r*2 as r, g*2 as g, b*2 as b, (r*0.2126::double+g*0.7152::double+b*0.0722::double)*2 as l from rgb), m as (select clip, r/(l+1) as r, g/(l+1) as g, b/(l+1) as b from u),
y as (select *, r*0.2126::double+g*0.7152::double+b*0.0722::double as l from m), z as (select *, least(1.0,greatest(0.0,{SMOOTH('(2.0::double**(-2.5))', '(2.0::double**0.25)', 'l')}**0.4::double)) as t from y),
x as (select clip, r+(l-r)*t as r, g+(l-g)*t as g, b+(l-b)*t as b from z) {MEAN_SQL}""",
    "d11_tone_map_mono": f"with {WITH_RGB} select clip, round(avg(g*2.0::double**2.5/(g*2.0::double**2.5+1)),6) as v from rgb group by clip",
    "d11_rolloff_levels": f"""with {WITH_RGB}, u as (select clip, r*2 as r, g*2 as g, b*2 as b, (r*0.2126::double+g*0.7152::double+b*0.0722::double)*2 as l from rgb), m as (select clip, r/(l+1) as r, g/(l+1) as g, b/(l+1) as b from u),
y as (select *, r*0.2126::double+g*0.7152::double+b*0.0722::double as l from m), z as (select *, 'none' as level, 0.0::double as t from y union all
select *, 'low', least(1.0,greatest(0.0,{SMOOTH('(2.0::double**(-2.0))', '(2.0::double**0.25)', 'l')}**0.5::double)) from y union all
select *, 'medium', least(1.0,greatest(0.0,{SMOOTH('(2.0::double**(-2.5))', '(2.0::double**0.25)', 'l')}**0.4::double)) from y union all
select *, 'high', least(1.0,greatest(0.0,{SMOOTH('(2.0::double**(-2.5))', '(2.0::double**0.25)', 'l')}**0.3::double)) from y)
select clip, level, avg(r+(l-r)*t) as r, avg(g+(l-g)*t) as g, avg(b+(l-b)*t) as b from z group by clip, level""",
    "d12_gamut_compress": "with " + WITH_RGB + ", q as (select clip, r, g, b-0.25 as b, greatest(r,g,b-0.25) as ac, 0.1::double/sqrt(0.2::double) as s from rgb), x as (select clip, " + ", ".join(f"ac-abs(ac)*(case when ac=0 then 0 when (ac-{c})/abs(ac)<0.9 then (ac-{c})/abs(ac) else s*sqrt(greatest(0.0,(ac-{c})/abs(ac)-0.9::double+s*s/4))-s*sqrt(s*s/4)+0.9::double end) as {c}" for c in "rgb") + f" from q) {PLAIN_MEAN_SQL}",
    "d13_gamma_curves": f"""with {WITH_RGB} select clip,
 round(avg(case when r<0.018053968510807::double then r*4.5 else 1.09929682680944::double*r**(1/2.2::double)-0.09929682680944::double end),6) as rec709,
 round(avg(case when r<0.0031308::double then r*12.92 else 1.055::double*r**(1/2.4::double)-0.055 end),6) as srgb,
 round(avg(case when r>0.010591::double then 0.247190::double*log10(5.555556::double*r+0.052272::double)+0.385537::double else 5.367655::double*r+0.092809::double end),6) as logc3,
 round(avg(case when r+0.01<0 then 15.1927::double*(r+0.01) else 0.224282::double*log10(155.975327::double*(r+0.01::double)+1) end),6) as log3g10,
 round(avg(case when r<0.005 then 8.283605932402494::double*r+0.09246575342465753::double else 0.08692876065491224::double*ln(r+0.005494072432257808::double)+0.5300133392291939::double end),6) as filmgen5 from rgb group by clip""",
    "d15_clipping_report": f"with {WITH_RGB}, n as (select clip, frame, (r>=0.99::double)::int+(g>=0.99::double)::int+(b>=0.99::double)::int as n from rgb) select clip, frame, " + ", ".join(f"count(*) filter (where n={i}) as n_clipped_{i}" for i in range(4)) + ", count(*) filter (where n>0)/count(*)::double as share from n group by clip, frame",
    "d20_quantise": f"with {WITH_RGB} select clip, " + ", ".join(f"sum(floor(least(1.0::double,greatest(0.0::double,{c}))*255)::bigint)::bigint as {c}8" for c in "rgb") + " from rgb group by clip",
    "f2_dedupe_requests": "select distinct l_orderkey as clip, cast(l_linenumber as bigint) as frame from lineitem",
    "f6_playout_quality": f"with {WITH_PLAYOUT} select clip, date_trunc('hour', ts) as window_start, kind, count(*) as n from playout group by all",
    "f6_sliding_quality": f"with {WITH_PLAYOUT}, w as (select clip, kind, unnest([time_bucket(interval 20 minutes, ts), time_bucket(interval 20 minutes, ts) - interval 20 minutes, time_bucket(interval 20 minutes, ts) - interval 40 minutes]) as window_start from playout) select clip, window_start, kind, count(*) as n from w group by all",
    "f7_play_sessions": f"""with {WITH_PLAYOUT}, s as (select *, case when ts <= lag(ts) over w + interval 30 minutes then 0 else 1 end as new from playout window w as (partition by clip order by ts, event_id)),
t as (select *, sum(new) over (partition by clip order by ts, event_id rows unbounded preceding) as session from s)
select clip, min(ts) as started, max(ts) as ended, count(*) as n_events from t group by clip, session""",
    "g1_recent_clips": f"with {WITH_HISTORY}, l as (select *, row_number() over (partition by path order by opened desc, event_id desc) as k from history where path<>'' and type<>'') select path, type, opened, event_id from l where k=1 order by opened desc, event_id desc limit 10",
    "g2_recent_by_user": f"with {WITH_HISTORY}, l as (select *, row_number() over (partition by user_id, path order by opened desc, event_id desc) as k from history where path<>'' and type<>''), r as (select user_id, path, type, opened, event_id, row_number() over (partition by user_id order by opened desc, event_id desc) as rank from l where k=1) select * from r where rank<=3",
    "g4_favourites": f"with {WITH_HISTORY}, f as (select distinct path from history join events using (event_id) where event_type='purchase') select distinct path, path in (select path from f) as is_favourite from history",
    "h2_white_xyz": "with p as (select c_custkey as clip, 0.25::double+(c_custkey%100)*0.002::double as wx, 0.28::double+(c_custkey%90)*0.0015::double as wy from customer) select clip, round(wx/wy,9) as x, 1.0::double as y, round((1-wx-wy)/wy,9) as z from p",
    "h3_cct": "with p as (select c_custkey as clip, ((0.25::double+(c_custkey%100)*0.002::double)-0.3366::double)/((0.28::double+(c_custkey%90)*0.0015::double)-0.1735::double) as n from customer) select clip, floor(-949.86315::double+6253.80338::double*exp(-n/0.92159::double)+28.70599::double*exp(-n/0.20039::double)+0.00004::double*exp(-n/0.07125::double)+0.5)::bigint as kelvin from p",
}
