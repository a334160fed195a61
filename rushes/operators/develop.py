"""Development of linear RGB samples as column expressions; components stay doubles."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLIP_LEVEL = 0.99


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.2126 + g * 0.7152 + b * 0.0722


def smoothstep(a, b, x: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a)))
    return t * t * (F.lit(3.0) - t * 2.0)


def levels(pixels: DataFrame, black: float, white: float) -> DataFrame:
    """(v - black) / (white - black), not clamped."""
    return pixels.withColumn("level", (F.col("v") - black) / (white - black))


def highlight_correct(rgb: DataFrame, white: tuple[float, float, float]) -> DataFrame:
    """Blends to the camera's white as the largest channel nears the clip level."""
    t = smoothstep(CLIP_LEVEL * 2**-0.5, CLIP_LEVEL, F.greatest("r", "g", "b"))
    return rgb.withColumn("t", t).withColumns({c: F.col(c) + (F.lit(w) - F.col(c)) * F.col("t") for c, w in zip("rgb", white)}).drop("t")


def exposure(rgb: DataFrame, stops: float) -> DataFrame:
    return rgb.withColumns({c: F.col(c) * float(2.0**stops) for c in "rgb"})


def to_display(rgb: DataFrame, m: list[float]) -> DataFrame:
    """Row-major 3 x 3 matrix on each sample, negative results to 0."""
    row = lambda i: F.greatest(F.lit(0.0), F.col("r") * m[3 * i] + F.col("g") * m[3 * i + 1] + F.col("b") * m[3 * i + 2])
    return rgb.withColumns({"r": row(0), "g": row(1), "b": row(2)})


def tone_map(rgb: DataFrame) -> DataFrame:
    """One stop up, then L / (L + 1) on luminance with channel ratios kept; black stays black."""
    up = rgb.withColumns({c: F.col(c) * 2.0 for c in "rgb"}).withColumn("l", luminance(F.col("r"), F.col("g"), F.col("b")))
    return up.withColumns({c: F.col(c) / (F.col("l") + 1.0) for c in "rgb"}).drop("l")


def tone_map_mono(values: DataFrame) -> DataFrame:
    """Two and a half stops up, then v / (v + 1)."""
    up = F.col("v") * 2.0**2.5
    return values.withColumn("v", up / (up + 1.0))


# Lower edge and power of the roll-off levels.
ROLL_OFF = {"low": (2**-2.0, 0.5), "medium": (2**-2.5, 0.4), "high": (2**-2.5, 0.3)}


def highlight_rolloff(rgb: DataFrame, level: str | None = "medium") -> DataFrame:
    """Mixes bright samples towards their luminance, by level (low, medium, high; None leaves them)."""
    if level is None:
        return rgb
    under, power = ROLL_OFF[level]
    lum = luminance(F.col("r"), F.col("g"), F.col("b"))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.pow(smoothstep(under, 2**0.25, F.col("l")), F.lit(power))))
    return rgb.withColumn("l", lum).withColumn("t", t).withColumns({c: F.col(c) + (F.col("l") - F.col(c)) * F.col("t") for c in "rgb"}).drop("l", "t")


def gamut_compress(rgb: DataFrame) -> DataFrame:
    """Draws the distance from the largest channel in, beyond 0.9 of it."""
    s = 0.1 / 0.2**0.5
    out = rgb.withColumn("ac", F.greatest("r", "g", "b"))

    def compressed(c):
        d = F.when(F.col("ac") == 0, 0.0).otherwise((F.col("ac") - F.col(c)) / F.abs("ac"))
        far = F.sqrt(F.greatest(F.lit(0.0), d - 0.9 + s * s / 4)) * s - s * (s * s / 4) ** 0.5 + 0.9
        return F.col("ac") - F.when(d < 0.9, d).otherwise(far) * F.abs("ac")

    return out.withColumns({c: compressed(c) for c in "rgb"}).drop("ac")


def encode_gamma(x: Column, space: str) -> Column:
    """Transfer curves; the constants are fixed values of the named spaces."""
    if space == "Rec709":
        a = 1.09929682680944
        return F.when(x < 0.018053968510807, x * 4.5).otherwise(F.pow(x, F.lit(1 / 2.2)) * a - (a - 1))
    if space == "sRGB":
        return F.when(x < 0.0031308, x * 12.92).otherwise(F.pow(x, F.lit(1 / 2.4)) * 1.055 - 0.055)
    if space == "LogC3":
        return F.when(x > 0.010591, F.log10(x * 5.555556 + 0.052272) * 0.247190 + 0.385537).otherwise(x * 5.367655 + 0.092809)
    if space == "Log3G10":
        y = x + 0.01
        return F.when(y < 0, y * 15.1927).otherwise(F.log10(y * 155.975327 + 1) * 0.224282)
    if space == "FilmGen5":
        return F.when(x < 0.005, x * 8.283605932402494 + 0.09246575342465753).otherwise(F.log(x + 0.005494072432257808) * 0.08692876065491224 + 0.5300133392291939)
    raise ValueError(space)


def clipping_report(rgb: DataFrame) -> DataFrame:
    """How many of a frame's samples have 0, 1, 2 and 3 channels at the clip level, and the share that has any."""
    n = sum(((F.col(c) >= CLIP_LEVEL).cast("int") for c in "rgb"), F.lit(0))
    counts = rgb.withColumn("n", n).groupBy("clip", "frame").agg(*[F.count_if(F.col("n") == i).alias(f"n_clipped_{i}") for i in range(4)])
    clipped = F.col("n_clipped_1") + F.col("n_clipped_2") + F.col("n_clipped_3")
    return counts.withColumn("share", clipped / (F.col("n_clipped_0") + clipped))


def quantise_8bit(rgb: DataFrame) -> DataFrame:
    return rgb.withColumns({f"{c}8": F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c))) * 255).cast("long") for c in "rgb"})
