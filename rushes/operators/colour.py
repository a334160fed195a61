"""Camera colour profiles: white points, temperature and tint, matrices; one row per clip."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rushes.functions import matrix3 as m3

# Mired, u, v and slope of the isotherms of the black-body locus.
LOCUS = [
    (0, 0.18006, 0.26352, -0.24341),
    (10, 0.18066, 0.26589, -0.25479),
    (20, 0.18133, 0.26846, -0.26876),
    (30, 0.18208, 0.27119, -0.28539),
    (40, 0.18293, 0.27407, -0.30470),
    (50, 0.18388, 0.27709, -0.32675),
    (60, 0.18494, 0.28021, -0.35156),
    (70, 0.18611, 0.28342, -0.37915),
    (80, 0.18740, 0.28668, -0.40955),
    (90, 0.18880, 0.28997, -0.44278),
    (100, 0.19032, 0.29326, -0.47888),
    (125, 0.19462, 0.30141, -0.58204),
    (150, 0.19962, 0.30921, -0.70471),
    (175, 0.20525, 0.31647, -0.84901),
    (200, 0.21142, 0.32312, -1.0182),
    (225, 0.21807, 0.32909, -1.2168),
    (250, 0.22511, 0.33439, -1.4512),
    (275, 0.23247, 0.33904, -1.7298),
    (300, 0.24010, 0.34308, -2.0637),
    (325, 0.24702, 0.34655, -2.4681),
    (350, 0.25591, 0.34951, -2.9641),
    (375, 0.26400, 0.35200, -3.5814),
    (400, 0.27218, 0.35407, -4.3633),
    (425, 0.28039, 0.35577, -5.3762),
    (450, 0.28863, 0.35714, -6.7262),
    (475, 0.29685, 0.35823, -8.5955),
    (500, 0.30505, 0.35907, -11.324),
    (525, 0.31320, 0.35968, -15.628),
    (550, 0.32129, 0.36011, -23.325),
    (575, 0.32931, 0.36038, -40.770),
    (600, 0.33724, 0.36051, -116.45),
]
TINT_SCALE = -3000.0
D50 = (0.3457, 0.3585)
# Kelvin of the illuminant codes.
KELVIN = {1: 5500, 2: 4150, 3: 2850, 4: 5500, 9: 5500, 10: 6500, 11: 7500, 12: 6400, 13: 5050, 14: 4150, 15: 3525, 16: 2925, 17: 2850, 18: 5500, 19: 6500, 20: 5500, 21: 6500, 22: 7500, 23: 5000, 24: 3200}
# Cone response, D50 to D65 adaptation, and XYZ to the display gamuts.
CONES = [0.8951, 0.2664, -0.1614, -0.7502, 1.7135, 0.0367, 0.0389, -0.0685, 1.0296]
D50_TO_D65 = [0.9555766, -0.0230393, 0.0631636, -0.0282895, 1.0099416, 0.0210077, 0.0122982, -0.0204830, 1.3299098]
GAMUTS_D65 = {
    "Rec709": [3.2404542, -1.5371385, -0.4985314, -0.9692660, 1.8760108, 0.0415560, 0.0556434, -0.2040259, 1.0572252],
    "Rec2020": [1.7166634, -0.3556733, -0.2533681, -0.6666738, 1.6164557, 0.0157683, 0.0176425, -0.0427770, 0.9422433],
    "AlexaWide": [1.789066, -0.482534, -0.200076, -0.639849, 1.396400, 0.194432, -0.041532, 0.082335, 0.878868],
    "RedWide": [1.412807, -0.177523, -0.151771, -0.486203, 1.290697, 0.157401, -0.037139, 0.286376, 0.687680],
    "BlackmagicWide": [1.866382, -0.518397, -0.234610, -0.600342, 1.378149, 0.176732, 0.002452, 0.086400, 0.836943],
}
GAMUTS_D50 = {
    "Rec709": [3.1338561, -1.6168667, -0.4906146, -0.9787684, 1.9161415, 0.0334540, 0.0719453, -0.2289914, 1.4052427],
    "Rec2020": [1.5742306, -0.3261628, -0.2323459, -0.6756925, 1.6383230, 0.0159816, 0.0234682, -0.0569023, 1.2533794],
}
for _wide in ("AlexaWide", "RedWide", "BlackmagicWide"):
    GAMUTS_D50[_wide] = (np.array(GAMUTS_D65[_wide]).reshape(3, 3) @ np.array(D50_TO_D65).reshape(3, 3)).ravel().tolist()
CONES_INVERSE = np.linalg.inv(np.array(CONES).reshape(3, 3)).ravel().tolist()


def illuminant_kelvin(code: Column) -> Column:
    """Null for an unknown code."""
    return F.create_map(*[F.lit(v) for pair in KELVIN.items() for v in pair])[code.cast("int")]


def xy_to_xyz(x: Column, y: Column) -> Column:
    """array(X, 1, Z) of a chromaticity held inside (0, 1), x + y at most 0.999999."""
    low, high = F.lit(1e-6), F.lit(0.999999)
    x, y = F.greatest(low, F.least(high, x)), F.greatest(low, F.least(high, y))
    fit = F.least(F.lit(1.0), high / (x + y))
    return F.array(x / y, F.lit(1.0), (F.lit(1.0) - x * fit - y * fit) / (y * fit))


def xyz_to_xy(v: str) -> tuple[Column, Column]:
    """x, y; D50 where the sum is not above 0."""
    total = F.expr(f"{v}[0] + {v}[1] + {v}[2]")
    return tuple(F.when(total > 0, F.expr(f"{v}[{i}]") / total).otherwise(F.lit(D50[i])) for i in (0, 1))


def _locus() -> Column:
    rows = []
    for r, u, v, t in LOCUS:
        size = math.hypot(1.0, t)
        rows.append(F.struct(*[F.lit(float(c)).alias(n) for n, c in zip(("r", "u", "v", "du", "dv"), (r, u, v, 1 / size, t / size))]))
    return F.array(*rows)


def with_temp_tint(df: DataFrame, x: str, y: str) -> DataFrame:
    """Adds kelvin and tint: the pair of isotherms around the point, then a blend by distance."""
    bottom = F.lit(1.5) - F.col(x) + F.col(y) * 6.0
    out = df.withColumns({"_u": F.col(x) * 2.0 / bottom, "_v": F.col(y) * 3.0 / bottom, "_locus": _locus()})
    out = out.withColumn("_dt", F.transform("_locus", lambda s: (F.col("_v") - s["v"]) * s["du"] - (F.col("_u") - s["u"]) * s["dv"]))
    # the first isotherm (after the one of 0 mired) that is not below the point, else the last
    out = out.withColumn("_i", F.expr(f"int(coalesce(nullif(array_position(transform(slice(_dt, 2, {len(LOCUS) - 1}), d -> d <= 0), true), 0), {len(LOCUS) - 1}))"))
    out = out.withColumns({"_a": F.expr("_locus[_i - 1]"), "_b": F.expr("_locus[_i]"), "_below": F.expr("greatest(-_dt[_i], cast(0 as double))"), "_above": F.expr("_dt[_i - 1]")})
    out = out.withColumn("_f", F.when(F.col("_i") == 1, 0.0).otherwise(F.expr("_below / (_above + _below)")))
    mix = lambda n: F.col(f"_a.{n}") * F.col("_f") + F.col(f"_b.{n}") * (F.lit(1.0) - F.col("_f"))
    out = out.withColumns({f"_m{n}": mix(n) for n in ("r", "u", "v", "du", "dv")})
    tint = ((F.col("_u") - F.col("_mu")) * F.col("_mdu") + (F.col("_v") - F.col("_mv")) * F.col("_mdv")) / F.sqrt(F.col("_mdu") ** 2 + F.col("_mdv") ** 2) * TINT_SCALE
    return out.withColumns({"kelvin": F.lit(1e6) / F.col("_mr"), "tint": tint}).select(*df.columns, "kelvin", "tint")


def with_xy_of_temp_tint(df: DataFrame, kelvin: str, tint: str) -> DataFrame:
    """Adds x and y; the last interval of the locus also serves warmer lights."""
    out = df.withColumns({"_r": F.lit(1e6) / F.col(kelvin), "_locus": _locus()})
    out = out.withColumn("_i", F.expr(f"int(coalesce(nullif(array_position(transform(slice(_locus, 2, {len(LOCUS) - 1}), s -> _r < s.r), true), 0), {len(LOCUS) - 1}))"))
    out = out.withColumns({"_a": F.expr("_locus[_i - 1]"), "_b": F.expr("_locus[_i]")}).withColumn("_f", F.expr("(_b.r - _r) / (_b.r - _a.r)"))
    mix = lambda n: F.col(f"_a.{n}") * F.col("_f") + F.col(f"_b.{n}") * (F.lit(1.0) - F.col("_f"))
    out = out.withColumns({f"_m{n}": mix(n) for n in ("u", "v", "du", "dv")}).withColumn("_step", F.col(tint) / TINT_SCALE / F.sqrt(F.col("_mdu") ** 2 + F.col("_mdv") ** 2))
    out = out.withColumns({"_u": F.col("_mu") + F.col("_mdu") * F.col("_step"), "_v": F.col("_mv") + F.col("_mdv") * F.col("_step")})
    bottom = F.col("_u") - F.col("_v") * 4.0 + 2.0
    return out.withColumns({"x": F.col("_u") * 1.5 / bottom, "y": F.col("_v") / bottom}).select(*df.columns, "x", "y")


def order_illuminants(profiles: DataFrame, swap_illuminants: bool = False) -> DataFrame:
    """The cooler light's matrices second; the codes stay in place unless asked for."""
    turned = F.coalesce(illuminant_kelvin(F.col("illum1")) > illuminant_kelvin(F.col("illum2")), F.lit(False))
    names = ["color_matrix", "forward_matrix"] + (["illum"] if swap_illuminants else [])
    new = {}
    for name in names:
        one, two = F.col(f"{name}1"), F.col(f"{name}2")
        new[f"{name}1"], new[f"{name}2"] = F.when(turned, two).otherwise(one), F.when(turned, one).otherwise(two)
    return profiles.withColumns(new)


def with_xyz_to_camera(profiles: DataFrame, x: str = "wx", y: str = "wy") -> DataFrame:
    """Adds xyz_to_camera: the one matrix, or a blend of two by the mired of the white."""
    out = with_temp_tint(profiles, x, y).withColumns({"_t1": illuminant_kelvin(F.col("illum1")).cast("double"), "_t2": illuminant_kelvin(F.col("illum2")).cast("double")})
    g = F.when(F.col("kelvin") <= F.col("_t1"), 1.0).when(F.col("kelvin") >= F.col("_t2"), 0.0).otherwise(F.expr("try_divide(1 / kelvin - 1 / _t2, 1 / _t1 - 1 / _t2)"))
    out = out.withColumn("_g", F.when(F.col("_t2").isNull(), 1.0).otherwise(g))
    return out.withColumn("xyz_to_camera", F.when(F.col("illum2").isNull(), F.col("color_matrix1")).otherwise(m3.lerp("color_matrix2", "color_matrix1", "_g"))).select(*profiles.columns, "xyz_to_camera")


def with_map_white(df: DataFrame, white1: str, white2: str, name: str = "map_white") -> DataFrame:
    """Adds the adaptation from one white (XYZ) to another; cone ratios stay within 0.1 and 10."""
    out = df.withColumns({"_cones": m3.literal(CONES), "_back": m3.literal(CONES_INVERSE)}).withColumns({"_w1": m3.apply("_cones", white1), "_w2": m3.apply("_cones", white2)})
    ratio = "zip_with(_w1, _w2, (a, b) -> greatest(cast(0.1 as double), least(cast(10 as double), case when a > 0 then greatest(b, cast(0 as double)) / a else cast(10 as double) end)))"
    out = out.withColumn("_ratio", F.expr(ratio)).withColumn("_scaled", F.expr("transform(sequence(0, 8), k -> _back[k] * _ratio[cast(k % 3 as int)])"))
    return out.withColumn(name, m3.multiply("_scaled", "_cones")).select(*df.columns, name)


def with_cct(df: DataFrame, x: str, y: str) -> DataFrame:
    n = (F.col(x) - 0.3366) / (F.col(y) - 0.1735)
    e = F.lit(-949.86315) + F.exp(-n / 0.92159) * 6253.80338 + F.exp(-n / 0.20039) * 28.70599 + F.exp(-n / 0.07125) * 0.00004
    return df.withColumn("cct", F.floor(e + 0.5).cast("double"))


def with_camera_to_xyz(profiles: DataFrame, x: str = "wx", y: str = "wy", white: str = "D50") -> DataFrame:
    """Adds camera_to_xyz for a D50 or D65 white, with forward matrices where there are any."""
    if white not in ("D50", "D65"):
        raise ValueError(white)
    out = with_xyz_to_camera(profiles, x, y).withColumns({"_white": xy_to_xyz(F.col(x), F.col(y)), "_d50": xy_to_xyz(F.lit(D50[0]), F.lit(D50[1]))})
    out = with_map_white(with_cct(out, x, y), "_d50", "_white", "_adapt")
    k1, k2 = illuminant_kelvin(F.col("illum1")).cast("double"), illuminant_kelvin(F.col("illum2")).cast("double")
    out = out.withColumns({"_lo": F.least(k1, k2), "_hi": F.greatest(k1, k2), "_first_low": k1 <= k2})
    out = out.withColumn("_t", F.expr("try_divide(1 / greatest(_lo, least(_hi, cct)) - 1 / _lo, 1 / _hi - 1 / _lo)"))
    out = out.withColumns({"_fa": F.expr("if(_first_low, forward_matrix1, forward_matrix2)"), "_fb": F.expr("if(_first_low, forward_matrix2, forward_matrix1)")})
    out = out.withColumn("_forward", F.when(F.col("illum2").isNull(), F.col("forward_matrix1")).otherwise(m3.lerp("_fa", "_fb", "_t")))
    # the camera's neutral: by the colour matrix for D50, by the inverted forward matrix for D65
    out = out.withColumn("_to_camera", F.col("xyz_to_camera") if white == "D50" else m3.inverse("_forward")).withColumn("_neutral", m3.apply("_to_camera", "_white"))
    out = out.withColumn("_unit", F.expr("transform(_neutral, c -> try_divide(c, array_max(_neutral)))")).withColumn("_pcs", m3.multiply("xyz_to_camera", "_adapt"))
    out = out.withColumn("camera_to_xyz", F.when(F.col("forward_matrix1").isNotNull(), m3.scale_columns("_forward", "_unit")).otherwise(m3.inverse("_pcs")))
    if white == "D65":
        out = out.withColumn("_d65", m3.literal(D50_TO_D65)).withColumn("camera_to_xyz", m3.multiply("camera_to_xyz", "_d65"))
    return out.select(*profiles.columns, "camera_to_xyz")


def display_matrix(gamut: Column, white: str = "D50") -> Column:
    """XYZ to a named gamut; null for another name."""
    out = F.lit(None).cast("array<double>")
    for name, values in {"D50": GAMUTS_D50, "D65": GAMUTS_D65}[white].items():
        out = F.when(gamut == name, m3.literal(values)).otherwise(out)
    return out


def with_camera_white(profiles: DataFrame, gamut: str) -> DataFrame:
    """Adds white_min and white_max: the display's white in camera values by the smallest, by the largest."""
    out = with_camera_to_xyz(profiles).withColumn("_display", display_matrix(F.col(gamut))).withColumn("_all", m3.multiply("_display", "camera_to_xyz")).withColumn("_inv", m3.inverse("_all"))
    out = out.withColumn("_one", m3.literal([1, 1, 1])).withColumn("_w", m3.apply("_inv", "_one"))
    return out.withColumns({"white_min": F.expr("transform(_w, c -> try_divide(c, array_min(_w)))"), "white_max": F.expr("transform(_w, c -> try_divide(c, array_max(_w)))")}).select(*profiles.columns, "white_min", "white_max")


def with_normalised(profiles: DataFrame, apply_scale: bool = False) -> DataFrame:
    """Adds color_norm and forward_norm. The scale of the colour matrix has no effect unless asked for."""
    out = profiles.withColumns({"_d50": xy_to_xyz(F.lit(D50[0]), F.lit(D50[1])), "_one": m3.literal([1, 1, 1])})
    out = out.withColumns({"_c": m3.apply("color_matrix1", "_d50"), "_f": m3.apply("forward_matrix1", "_one")}).withColumn("_top", F.array_max("_c"))
    scaled = F.when((F.col("_top") > 0) & ~F.col("_top").between(0.99, 1.01), F.expr("transform(color_matrix1, c -> try_divide(c, _top))")).otherwise(F.col("color_matrix1"))
    rows = F.expr("transform(sequence(0, 8), k -> try_divide(forward_matrix1[k] * _d50[cast(k div 3 as int)], _f[cast(k div 3 as int)]))")
    return out.withColumns({"color_norm": scaled if apply_scale else F.col("color_matrix1"), "forward_norm": F.when(F.col("forward_matrix1").isNotNull(), rows)}).select(*profiles.columns, "color_norm", "forward_norm")


def with_temp_tint_offset(profiles: DataFrame, kelvin: float, tint: float) -> DataFrame:
    """Adds color_offset: the first colour matrix moved by a temperature and tint."""
    out = profiles.withColumn("_t", illuminant_kelvin(F.col("illum1")).cast("double")).withColumns({"_t2": F.col("_t") + kelvin, "_zero": F.lit(0.0), "_tint": F.lit(float(tint))})
    out = with_xy_of_temp_tint(out, "_t", "_zero").withColumnsRenamed({"x": "_x1", "y": "_y1"})
    out = with_xy_of_temp_tint(out, "_t2", "_tint").withColumnsRenamed({"x": "_x2", "y": "_y2"})
    out = out.withColumns({"_target": xy_to_xyz(F.col("_x1"), F.col("_y1")), "_moved": xy_to_xyz(F.col("_x2"), F.col("_y2"))})
    return with_map_white(out, "_moved", "_target", "_adapt").withColumn("color_offset", m3.multiply("color_matrix1", "_adapt")).select(*profiles.columns, "color_offset")


def _kelvin_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    locus = np.array(LOCUS, float)
    size = np.hypot(1.0, locus[:, 3])
    du, dv = 1 / size, locus[:, 3] / size
    bottom = 1.5 - x + 6 * y
    u, v = 2 * x / bottom, 3 * y / bottom
    dt = (v[:, None] - locus[:, 2]) * du - (u[:, None] - locus[:, 1]) * dv
    below = dt[:, 1:] <= 0
    i = np.where(below.any(1), below.argmax(1) + 1, len(LOCUS) - 1)
    row = np.arange(len(x))
    d = np.maximum(0.0, -dt[row, i])
    f = np.where(i == 1, 0.0, d / np.where(i == 1, 1.0, dt[row, i - 1] + d))
    return 1e6 / (locus[i - 1, 0] * f + locus[i, 0] * (1 - f))


def neutral_to_xy(profiles: DataFrame, passes: int = 30) -> DataFrame:
    """clip, x, y: the white whose camera value is the neutral, by repeated steps from D50.

    A batch of clips takes its steps together. Null without a neutral or a first matrix.
    """

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = pd.DataFrame({"clip": rows["clip"], "x": np.nan, "y": np.nan})
            ok = (rows["neutral"].notna() & rows["color_matrix1"].notna()).to_numpy()
            if ok.any():
                use = rows[ok]
                one = np.stack(use["color_matrix1"]).reshape(-1, 3, 3)
                dual = (use["_t2"].notna() & use["color_matrix2"].notna()).to_numpy()
                two = np.stack([b if d else a for a, b, d in zip(use["color_matrix1"], use["color_matrix2"], dual)]).reshape(-1, 3, 3)
                t1, t2 = use["_t1"].to_numpy(float), use["_t2"].to_numpy(float)
                neutral = np.stack(use["neutral"])[:, :, None]
                x, y = (np.full(len(use), v) for v in D50)
                moving = np.ones(len(use), bool)
                for turn in range(passes):
                    kelvin = _kelvin_of(x, y)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        g = np.where(kelvin <= t1, 1.0, np.where(kelvin >= t2, 0.0, (1 / kelvin - 1 / t2) / (1 / t1 - 1 / t2)))
                    g = np.where(dual, np.clip(g, 0, 1), 1.0)[:, None, None]
                    xyz = (np.linalg.inv(two + (one - two) * g) @ neutral)[:, :, 0]
                    total = xyz.sum(1)
                    safe = np.where(total > 0, total, 1.0)
                    nx, ny = (np.where(total > 0, xyz[:, i] / safe, D50[i]) for i in (0, 1))
                    done = np.abs(nx - x) + np.abs(ny - y) < 1e-7
                    if turn == passes - 1:
                        nx, ny = np.where(done, nx, (x + nx) / 2), np.where(done, ny, (y + ny) / 2)
                    x, y = np.where(moving, nx, x), np.where(moving, ny, y)
                    moving &= ~done
                    if not moving.any():
                        break
                out.loc[ok, "x"], out.loc[ok, "y"] = x, y
            yield out

    wanted = profiles.select("clip", "neutral", "color_matrix1", "color_matrix2", illuminant_kelvin(F.col("illum1")).cast("double").alias("_t1"), illuminant_kelvin(F.col("illum2")).cast("double").alias("_t2"))
    return wanted.mapInPandas(solve, "clip long, x double, y double").select("clip", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "xy"])


def as_shot_white(profiles: DataFrame, by_neutral: DataFrame) -> DataFrame:
    """clip, x, y: by the neutral, else the recorded white, else daylight of 5500 K and tint 10."""
    day = with_xy_of_temp_tint(profiles.withColumns({"_k": F.lit(5500.0), "_tint": F.lit(10.0)}), "_k", "_tint")
    found = by_neutral.select("clip", F.col("x").alias("_nx"), F.col("y").alias("_ny"))
    return day.join(found, "clip", "left").select("clip", F.coalesce("_nx", "wx", "x").alias("x"), F.coalesce("_ny", "wy", "y").alias("y"))


# White balance by name; the recorded one has none.
WHITE_BALANCE = {"as shot": None, "shade": (7500.0, 10.0), "cloud": (6500.0, 10.0), "daylight": (5500.0, 10.0), "fluorescent": (3800.0, 21.0), "tungsten": (3200.0, 0.0)}


def presets(clips: DataFrame) -> DataFrame:
    """clip, kind, preset, kelvin, tint, exposure: what each clip can be set to. clips: clip, baseline_exposure.

    White balances are the same for all; exposures are the recorded one and whole stops
    around it, rounded to even, 0 where there is none. A setting that is not the row's is null.
    """
    nothing = F.lit(None).cast("double")
    white = [F.struct(F.lit("white balance").alias("kind"), F.lit(n).alias("preset"), *[(F.lit(v[i]) if v else nothing).alias(c) for i, c in enumerate(("kelvin", "tint"))], nothing.alias("exposure")) for n, v in WHITE_BALANCE.items()]
    base = F.bround(F.coalesce("baseline_exposure", F.lit(0.0)))
    steps = {"as shot": None, "minus two": -2, "minus one": -1, "zero": 0, "plus one": 1, "plus two": 2}
    stops = [F.struct(F.lit("exposure").alias("kind"), F.lit(n).alias("preset"), nothing.alias("kelvin"), nothing.alias("tint"), (nothing if v is None else base + float(v)).alias("exposure")) for n, v in steps.items()]
    return clips.select("clip", F.explode(F.array(*white, *stops)).alias("p")).select("clip", "p.*")


def effective_params(clips: DataFrame, overrides: DataFrame) -> DataFrame:
    """Settings in force: the clip's own, else defaults; a gamma stays for the next clips of a session.

    clips: clip, session, opened, baseline_exposure. overrides: clip and nullable settings.
    """
    joined = clips.join(overrides, "clip", "left")
    order = Window.partitionBy("session").orderBy("opened", "clip")
    base = F.coalesce("baseline_exposure", F.lit(0.0))
    return joined.select(
        "clip",
        F.coalesce("exposure", base).alias("exposure"),
        F.coalesce(F.last("gamma", ignorenulls=True).over(order), F.lit("Rec709")).alias("gamma"),
        F.coalesce("tone_map", F.lit("SDR")).alias("tone_map"),
        F.coalesce("recovery", F.lit("On")).alias("recovery"),
        F.coalesce("rolloff", F.lit("Medium")).alias("rolloff"),
        F.coalesce("gamut", F.lit("Rec709")).alias("gamut"),
        (F.bround(base) - 2).cast("long").alias("lowest_preset"),
        (F.bround(base) + 2).cast("long").alias("highest_preset"),
    )
