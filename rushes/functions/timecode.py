"""SMPTE timecode as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def bcd(value: Column, tens_bits: int) -> Column:
    """Two BCD digits of a byte: four bits of units, then so many of tens."""
    tens = F.shiftright(value.cast("int"), 4).bitwiseAND(F.lit((1 << tens_bits) - 1))
    return (value.cast("int").bitwiseAND(F.lit(15)) + tens * 10).cast("long")


def smpte_decode(b0: Column, b1: Column, b2: Column, b3: Column) -> dict[str, Column]:
    """Fields of the first four bytes: BCD numbers, the drop flag and the four user flags."""
    bit = lambda b, at: F.shiftright(b.cast("int"), at).bitwiseAND(F.lit(1)) == 1
    flags = {"is_drop": bit(b0, 6), "flag1": bit(b1, 7), "flag2": bit(b2, 7), "flag3": bit(b3, 6), "flag4": bit(b3, 7)}
    return {"ff": bcd(b0, 2), "ss": bcd(b1, 3), "mm": bcd(b2, 3), "hh": bcd(b3, 2), **flags}


def drop_frames(n: str, drop: int) -> Column:
    """Frame number with the dropped numbers put back; drop is 2 at 29.97 and 4 at 59.94."""
    ten_minutes = 8991 * drop
    return F.expr(f"{n} + {9 * drop} * ({n} div {ten_minutes}) + {drop} * (({n} % {ten_minutes} - {drop}) div {ten_minutes // 10})")


def parts(n: Column, rate: int, wrap: bool = False) -> dict[str, Column]:
    """hh, mm, ss, ff of a frame number at an integer rate."""
    second = F.floor(n / rate)
    hour = F.floor(second / 3600)
    return {"hh": (hour % 24 if wrap else hour), "mm": F.floor(second / 60) % 60, "ss": second % 60, "ff": n % rate}


def label(p: dict[str, Column], drop: bool) -> Column:
    two = lambda c: F.when(c < 100, F.lpad(c.cast("string"), 2, "0")).otherwise(c.cast("string"))
    return F.concat(two(p["hh"]), F.lit(":"), two(p["mm"]), F.lit(":"), two(p["ss"]), F.lit(";" if drop else ":"), two(p["ff"]))


def frames_of(p: dict[str, Column], drop: int = 0, rate: int = 25) -> Column:
    """Inverse of the above: drop-frame at 29.97 (drop 2) or 59.94 (drop 4), else at the rate."""
    minutes = p["hh"] * 60 + p["mm"]
    if not drop:
        return p["ff"] + p["ss"] * rate + minutes * 60 * rate
    scale = drop // 2
    return p["hh"] * (108000 * scale) + p["mm"] * (1800 * scale) + p["ss"] * (30 * scale) + p["ff"] - drop * (minutes - F.floor(minutes / 10))


def is_drop_rate(num: Column, den: Column) -> Column:
    """Only 30000/1001 and 60000/1001 as written; an equal fraction is another rate."""
    return F.coalesce((den == 1001) & num.isin(30000, 60000), F.lit(False))


def rate_columns(num: str = "rate_num", den: str = "rate_den", flag: Column | None = None) -> dict[str, Column]:
    """rate (whole frames a second, 24 where there is none) and drop_step (2, 4 or 0).

    flag is a start timecode's drop flag: where it is not null it decides, not the rate, and
    drop_step is -1 where it asks for dropping at a rate that has none.
    """
    drops = is_drop_rate(F.col(num), F.col(den))
    step = F.when(drops, F.col(num) / 15000).otherwise(0)
    if flag is not None:
        step = F.when(flag.isNull(), step).when(~flag, 0).when(drops, step).otherwise(-1)
    return {"rate": F.coalesce(F.round(F.col(num) / F.col(den)), F.lit(24)).cast("long"), "drop_step": step.cast("long")}


def renumbered(n: str) -> Column:
    """The number in column n with dropped numbers put back, by the column drop_step."""
    ten = "(8991 * greatest(drop_step, 2))"
    return F.expr(f"if(drop_step <= 0, {n}, {n} + 9 * drop_step * ({n} div {ten}) + drop_step * (({n} % {ten} - drop_step) div ({ten} div 10)))")


def timecode_at_rate(n: str, hours: bool = True) -> Column:
    """Text of the renumbered frame in column n at the columns rate and drop_step.

    Hours wrap at 24 with dropped frames only; without hours, minutes go on. Where dropping
    is asked for at a rate that has none (drop_step -1) all is 0.
    """
    two = lambda e: f"lpad(cast({e} as string), greatest(2, length(cast({e} as string))), '0')"
    second = f"({n} div rate)"
    minute = f"({second} div 60 % 60)" if hours else f"({second} div 60)"
    hour = two(f"if(drop_step = 0, {second} div 3600, {second} div 3600 % 24)") + ", ':', " if hours else ""
    text = f"concat({hour}{two(minute)}, ':', {two(f'({second} % 60)')}, if(drop_step = 0, ':', ';'), {two(f'({n} % rate)')})"
    return F.expr(f"if(drop_step < 0, '{'00:' if hours else ''}00:00;00', {text})")


def frames_at_rate(hh: str, mm: str, ss: str, ff: str) -> Column:
    """Frame number of a timecode at the columns rate and drop_step."""
    minutes = f"({hh} * 60 + {mm})"
    return F.expr(f"{ff} + ({ss} + {minutes} * 60) * rate - greatest(drop_step, 0) * ({minutes} - {minutes} div 10)")
