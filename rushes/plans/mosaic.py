"""Registered queries of mosaic samples and their DuckDB SQL."""

from pyspark.sql import functions as F

from rushes.operators import bands, mosaic
from rushes.plans.queries import MATRIX, WHITE, WITH_RGB
from rushes.sources import footage as src

PATTERNS = ["RGGB", "BGGR", "GRBG", "GBRG"]


def samples(spark, d):
    """Mosaics of 0 to 1 with a pattern by frame."""
    pattern = F.element_at(F.array(*[F.lit(p) for p in PATTERNS]), (F.col("frame") % 4 + 1).cast("int"))
    return src.pixels(spark, d).select("frame", "y", "x", (F.col("v") / 65535).alias("v"), pattern.alias("pattern"))


def _packed(spark, d):
    e = src.table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("frame"), F.expr("transform(slice(embedding, 1, 63), e -> cast(floor((cast(e as double) + cast(0.6 as double)) * 200) as int))").alias("bytes"))


def unpacked(spark, d):
    out = _packed(spark, d)
    digest = lambda bits, size: F.aggregate(F.transform(mosaic.unpack_bits("bytes", bits, size), lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, v: s + v)
    return out.select("frame", digest(10, 60).alias("bits10"), digest(12, 60).alias("bits12"), digest(14, 63).alias("bits14"))


def linear(spark, d):
    curve = F.expr("transform(sequence(0, 15), i -> cast(i * i * (200 + frame % 4 * 20) as double))")
    out = mosaic.linearise(samples(spark, d).withColumn("v", F.col("v") / 16).withColumn("curve", curve), "curve")
    return out.groupBy("frame").agg(F.round(F.avg("v"), 6).alias("v"), F.round(F.max("v"), 6).alias("most"))


def colours(spark, d, sites=("R", "G", "B")):
    out = bands.debayer_bands(samples(spark, d), rows=4).where(F.col("site").isin(*sites))
    return out.select("frame", "y", "x", *[F.round(c, 6).alias(c) for c in "rgb"])


def green(spark, d):
    return colours(spark, d, ("R", "B")).select("frame", "y", "x", "g")


def opposite(spark, d):
    out = bands.debayer_bands(samples(spark, d), rows=4).where("site <> 'G'")
    return out.select("frame", "y", "x", F.round(F.when(F.col("site") == "R", F.col("b")).otherwise(F.col("r")), 6).alias("other"))


def turned(spark, d):
    p = src.pixels(spark, d).withColumn("orientation", F.col("frame") % 8 + 1)
    return mosaic.crop_orient(p, (1, 1, 7, 5), "orientation").select("frame", "y", "x", "v")


def tiles(spark, d):
    e = src.table(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tile"), "embedding")
    rows = e.select("frame", "tile", F.expr("transform(slice(embedding, tile * 16 + 1, 16), e -> cast(floor((cast(e as double) + cast(0.6 as double)) * 65535) as bigint))").alias("samples"))
    return mosaic.assemble_tiles(rows, 4, 4, 7, 6).select("frame", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v")


def _rebuilt(predictor):
    def query(spark, d):
        residuals = src.pixels(spark, d).select("frame", "y", "x", (F.col("v") % 512 - 256).alias("d"))
        return bands.rebuild_bands(residuals, predictor, rows=3)

    return query


def recovered(spark, d):
    out = mosaic.highlight_recovery(src.rgb(spark, d), tuple(w / min(WHITE) for w in WHITE))
    return out.groupBy("clip").agg(*[F.avg(c).alias(c) for c in "rgb"])


def developed(spark, d):
    out = bands.develop_bands(samples(spark, d), 0.05, 0.95, WHITE, MATRIX, 0.5, rows=4)
    return out.groupBy("frame").agg(*[F.avg(c).alias(c) for c in "rgb"])


QUERIES = {
    "d1_unpack_bits": unpacked,
    "d2_linearise": linear,
    "d4_debayer_green": green,
    "d5_chroma_at_chroma": opposite,
    "d6_chroma_at_green": lambda s, d: colours(s, d, ("G",)),
    "d7_debayer": colours,
    "d8_highlight_recovery": recovered,
    "d14_crop_orient": turned,
    "d16_develop": developed,
    "d17_assemble_tiles": tiles,
    **{f"d18_predictor_{p}": _rebuilt(p) for p in (1, 2, 3, 4)},
    "d19_expand_precision": lambda s, d: src.pixels(s, d).groupBy("frame").agg(F.sum(mosaic.expand_precision(F.col("v") % 4096, 16, 12)).alias("v")),
}

_GRID = """lists as (select vec_id as frame, [floor(least(greatest(cast(e as double)+0.6::double,0::double),1::double)*65535) for e in embedding] as v from embeddings),
grid as (select frame, v, y, x from lists, range(8) as a(y), range(8) as b(x))"""
_RESIDUAL = f"{_GRID}, d as (select frame, y, x, v[y*8+x+1]::bigint%512-256 as d from grid)"


def _n(dy, dx):
    return f"(v[least(7,greatest(0,y+({dy})))*8+least(7,greatest(0,x+({dx})))+1]/65535)"


def _weight(a, b):
    return f"1/greatest(0.0001::double,abs(green-({a}+{b})/2))"


_A, _B, _L, _R, _C = _n(-1, 0), _n(1, 0), _n(0, -1), _n(0, 1), _n(0, 0)
_TL, _TR, _BL, _BR = _n(-1, -1), _n(-1, 1), _n(1, -1), _n(1, 1)
_DH, _DV = f"(({_C}-{_n(0, -2)})+({_C}-{_n(0, 2)}))", f"(({_C}-{_n(-2, 0)})+({_C}-{_n(2, 0)}))"


def _side(p, q, one, two):
    return f"{one}+({two}-{one})*least(1::double,greatest(0::double,{p}/greatest(0.0001::double,{p}+{q})))"


_N, _S, _W, _E = (f"abs(({p}+{q})/2-{_C})" for p, q in ((_TL, _TR), (_BL, _BR), (_TL, _BL), (_TR, _BR)))
WITH_COLOURS = f"""{_GRID}, s as (select *, substr(['RGGB','BGGR','GRBG','GBRG'][frame%4+1], (y%2)*2+x%2+1, 1) as site, substr(['RGGB','BGGR','GRBG','GBRG'][frame%4+1], (y%2)*2+(x+1)%2+1, 1) as beside from grid),
gr as (select *, abs({_L}-{_R}+abs({_DH})) as gh, abs({_A}-{_B}+abs({_DV})) as gv from s),
g as (select *, case when gh=gv then ({_A}+{_B}+{_L}+{_R})/4+({_DH}+{_DV})/8 when gh>gv then ({_A}+{_B})/2+{_DV}/4 else ({_L}+{_R})/2+{_DH}/4 end as green from gr),
w as (select *, {_weight(_A, _L)} as w1, {_weight(_A, _R)} as w2, {_weight(_B, _L)} as w3, {_weight(_R, _B)} as w4 from g),
o as (select *, ({_TL}*w1+{_TR}*w2+{_BL}*w3+{_BR}*w4)/(w1+w2+w3+w4) as other, {_side(_N, _S, _A, _B)} as down, {_side(_W, _E, _L, _R)} as across from w),
colours as (select frame, y, x, site, round(other,6) as other, round(case site when 'R' then {_C} when 'G' then case when beside='R' then across else down end else other end,6) as r, round(case when site='G' then {_C} else green end,6) as g,
 round(case site when 'B' then {_C} when 'G' then case when beside='B' then across else down end else other end,6) as b from o)"""
_SEED = "select frame, y, x, ((32768+s)%65536+65536)%65536 as v from t"


def _sum_sql(condition):
    return f"with {_RESIDUAL}, t as (select a.frame, a.y, a.x, sum(b.d)::bigint as s from d a join d b on a.frame=b.frame and ({condition}) group by all) {_SEED}"


def _bits_sql():
    """By the groups of bytes: 5 bytes hold 4 samples of 10 bits, 3 hold 2 of 12, 7 hold 4 of 14."""
    byte = lambda size, k: f"b[g*{size}+{k + 1}]"
    whole = lambda size: "(" + "+".join(f"{byte(size, k)}*{256 ** (size - 1 - k)}" for k in range(size)) + ")"

    def digest(bits, size, groups):
        per = size * 8 // bits
        terms = "+".join(f"(({whole(size)}//{2 ** (bits * (per - 1 - k))})%{2**bits})*(g*{per}+{k + 1})" for k in range(per))
        return f"list_sum([{terms} for g in range({groups})])::bigint as bits{bits}"

    return f"with p as (select vec_id as frame, [floor((cast(e as double)+0.6::double)*200)::bigint for e in embedding[1:63]] as b from embeddings) select frame, {digest(10, 5, 12)}, {digest(12, 3, 20)}, {digest(14, 7, 9)} from p"


def _steps(a, b, x):
    t = f"least(1.0::double,greatest(0.0::double,(({x})-({a}))/(({b})-({a}))))"
    return f"({t}*{t}*(3-2*{t}))"


def recovery_sql(source, white):
    """CTEs from source (r, g, b and others) to recovered (the same columns) by the camera's white."""
    c, out, before = "rgb", [], source

    def stage(name, columns):
        nonlocal before
        out.append(f"{name} as (select *, " + ", ".join(f"{e} as {n}" for n, e in columns.items()) + f" from {before})")
        before = name

    lerp = lambda a, b, t: f"(({a})+(({b})-({a}))*({t}))"
    for u in range(3):
        o = [k for k in range(3) if k != u]
        stage(f"want{u}", {f"y{u}{k}": f"{c[u]}*{white[k] / max(1e-3, white[u])!r}::double" for k in o} | {f"t{u}": _steps("0.2475::double", "0.99::double", c[u])})
        stage(f"scale{u}", {f"s{u}": "(" + "+".join(f"{c[k]}/greatest(0.001::double,y{u}{k})" for k in o) + ")/2", f"over{u}": " or ".join(f"{c[k]}>y{u}{k}" for k in o)})
        two = {f"two{u}{u}": lerp(c[u], f"{white[u]!r}::double", f"t{u}")}
        for k in o:
            high = f"greatest({c[k]},y{u}{k})"
            two[f"two{u}{k}"] = lerp(f"case when over{u} then {high}*0.4::double+y{u}{k}*s{u}*0.6::double else {high} end", f"{white[k]!r}::double", f"t{u}")
        stage(f"pair{u}", two)
    for k in range(3):
        u1, u2 = [n for n in range(3) if n != k]
        a, b = c[u1], c[u2]
        stage(f"mid{k}", {f"m{k}": f"case when {a}<{b} then {b} else {a} end", f"w{k}": f"case when {a}<{b} then {white[u2]!r}::double else {white[u1]!r}::double end", f"g{k}": _steps("-0.5::double", "0.5::double", f"log2(greatest(1e-30::double,{a})/greatest(0.001::double,{b}))")})
        stage(f"low{k}", {f"q{k}": f"w{k}/greatest(0.001::double,m{k})", f"l{k}": f"least(m{k},w{k}*w{k}/greatest(0.001::double,m{k}))"})
        stage(f"edge{k}", {f"e{k}": _steps(f"l{k}", f"greatest(0.99::double,l{k}+1e-12::double)", f"m{k}")})
        stage(f"single{k}", {f"one{k}{n}": lerp(lerp(f"two{u1}{n}", f"two{u2}{n}", f"g{k}"), f"{white[n]!r}::double*q{k}", f"e{k}") for n in range(3)})
    stage("counted", {"nc": "+".join(f"({x}>=0.99::double)::int" for x in c), "top": "greatest(r,g,b)"})
    stage("picked", {"ci": "case when nc=1 then case when r>=0.99::double then 0 when g>=0.99::double then 1 else 2 end when r=top then 0 when g=top then 1 else 2 end", "ui": "case when r<0.99::double then 0 when g<0.99::double then 1 else 2 end", "close": _steps("0.495::double", "0.99::double", "top")})
    pick = lambda kind, by, n: f"case {by} when 0 then {kind}0{n} when 1 then {kind}1{n} else {kind}2{n} end"
    new = ", ".join(f"case nc when 3 then {white[n]!r}::double when 2 then {pick('two', 'ui', n)} when 1 then {pick('one', 'ci', n)} else {lerp(c[n], pick('one', 'ci', n), 'close')} end as {c[n]}" for n in range(3))
    out.append(f"recovered as (select * replace ({new}) from picked)")
    return ", ".join(out)


LEAST_WHITE = tuple(w / min(WHITE) for w in WHITE)
_LIGHT = "(r*0.2126::double+g*0.7152::double+b*0.0722::double)"
_FAR = "(0.1::double/sqrt(0.2::double))"
# the same in the order of the operator's sums: a highlight's largest channel can hang on the last bit
_DH2, _DV2 = f"(2*{_C}-{_n(0, -2)}-{_n(0, 2)})", f"(2*{_C}-{_n(-2, 0)}-{_n(2, 0)})"
_EXACT = WITH_COLOURS.replace(f"({_A}+{_B}+{_L}+{_R})/4+({_DH}+{_DV})/8", f"((({_L}+{_R})/2+{_DH2}/4)+(({_A}+{_B})/2+{_DV2}/4))/2").replace(_DH, _DH2).replace(_DV, _DV2).replace("round(other,6) as other, ", "").replace("round(case", "(case").replace("end,6)", "end)")
DEVELOPED = f"""{_EXACT},
lev as (select frame, (r-0.05::double)/(0.95::double-0.05::double) as r, (g-0.05::double)/(0.95::double-0.05::double) as g, (b-0.05::double)/(0.95::double-0.05::double) as b from colours),
{recovery_sql('lev', LEAST_WHITE)},
ex as (select frame, r*2.0::double**0.5 as r, g*2.0::double**0.5 as g, b*2.0::double**0.5 as b from recovered),
di as (select frame, greatest(0.0,r*1.2-g*0.15-b*0.05) as r, greatest(0.0,g*1.15-r*0.1-b*0.05) as g, greatest(0.0,b*1.2-g*0.2) as b from ex),
up as (select frame, 2*r/(2*{_LIGHT}+1) as r, 2*g/(2*{_LIGHT}+1) as g, 2*b/(2*{_LIGHT}+1) as b from di),
ro as (select *, {_LIGHT} as l, least(1.0,greatest(0.0,{_steps('2.0::double**(-2.5)', '2.0::double**0.25', _LIGHT)}**0.4::double)) as t from up),
so as (select frame, r+(l-r)*t as r, g+(l-g)*t as g, b+(l-b)*t as b from ro),
ga as (select *, greatest(r,g,b) as ac, {_FAR} as s from so),
cg as (select frame, """ + ", ".join(f"ac-abs(ac)*(case when ac=0 then 0 when (ac-{c})/abs(ac)<0.9 then (ac-{c})/abs(ac) else s*sqrt(greatest(0.0,(ac-{c})/abs(ac)-0.9::double+s*s/4))-s*sqrt(s*s/4)+0.9::double end) as {c}" for c in "rgb") + " from ga)"
_REC709 = "(case when {c}<0.018053968510807::double then {c}*4.5 else 1.09929682680944::double*{c}**(1/2.2::double)-0.09929682680944::double end)"


ORACLES = {
    "d1_unpack_bits": _bits_sql(),
    "d2_linearise": f"with {_GRID}, p as (select frame, 200+frame%4*20 as k, v[y*8+x+1]/65535/16/(4095/65535::double)*16-0.5::double as p from grid), q as (select frame, k, p-floor(p) as f, greatest(0,least(15,floor(p))) as lo, greatest(0,least(15,floor(p)+1)) as hi from p), l as (select frame, (lo*lo*k+(hi*hi*k-lo*lo*k)*f)/65535 as v from q) select frame, round(avg(v),6) as v, round(max(v),6) as most from l group by frame",
    "d4_debayer_green": f"with {WITH_COLOURS} select frame, y, x, g from colours where site<>'G'",
    "d5_chroma_at_chroma": f"with {WITH_COLOURS} select frame, y, x, other from colours where site<>'G'",
    "d6_chroma_at_green": f"with {WITH_COLOURS} select frame, y, x, r, g, b from colours where site='G'",
    "d7_debayer": f"with {WITH_COLOURS} select frame, y, x, r, g, b from colours",
    "d8_highlight_recovery": f"with {WITH_RGB}, {recovery_sql('rgb', LEAST_WHITE)} select clip, avg(r) as r, avg(g) as g, avg(b) as b from recovered group by clip",
    "d16_develop": f"with {DEVELOPED} select frame, " + ", ".join(f"avg({_REC709.format(c=c)}) as {c}" for c in "rgb") + " from cg group by frame",
    "d14_crop_orient": f"with {_GRID}, c as (select frame, y, x, v[y*8+x+1]::bigint as v, frame%8+1 as o from grid where x<6 and y<4) select frame, case when o in (1,2) then y when o in (3,4) then 3-y when o in (5,6) then x else 5-x end as y, case when o in (1,4) then x when o in (2,3) then 5-x when o in (5,8) then y else 3-y end as x, v from c",
    "d17_assemble_tiles": "with g as (select vec_id as frame, embedding as e, y, x from embeddings, range(6) as a(y), range(7) as b(x)) select frame, y, x, floor((cast(e[((y//4)*2+x//4)*16+(y%4)*4+x%4+1] as double)+0.6::double)*65535)::bigint as v from g",
    "d18_predictor_1": _sum_sql("(b.x=0 and b.y<=a.y) or (b.y=a.y and b.x between 1 and a.x)"),
    "d18_predictor_2": _sum_sql("(b.y=0 and b.x<=a.x) or (b.x=a.x and b.y between 1 and a.y)"),
    "d18_predictor_3": _sum_sql("(b.y=0 and b.x<=a.x-a.y) or (a.x<a.y and b.x=0 and b.y<=a.y-a.x) or (b.x-b.y=a.x-a.y and least(b.x,b.y)>=1 and b.y<=a.y)"),
    "d18_predictor_4": _sum_sql("b.x<=a.x and b.y<=a.y"),
    "d19_expand_precision": f"with {_GRID} select frame, sum((v[y*8+x+1]::bigint%4096)*16)::bigint as v from grid group by frame",
}
