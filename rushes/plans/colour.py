"""Registered colour profile queries and their DuckDB SQL."""

from pyspark.sql import functions as F

from rushes.functions import matrix3 as m3
from rushes.operators import colour
from rushes.sources import footage as src

_K = "c_custkey"
_M1 = "[m00,-0.2::double,-0.05::double,-0.4::double,1.2::double,0.2::double,-0.1::double,0.2::double,0.6::double]"
_M2 = "[m00+0.05::double,-0.2::double,-0.05::double,-0.4::double,1.25::double,0.2::double,-0.1::double,0.2::double,0.65::double]"
_FM1 = "[0.45::double,0.38::double,0.13::double,0.22::double,0.72::double,0.06::double,0.02::double,0.08::double,0.72::double]"
_FM2 = "[0.47::double,0.36::double,0.13::double,0.24::double,0.70::double,0.06::double,0.02::double,0.06::double,0.74::double]"


def _locus_sql():
    rows = ",".join(f"({i},{r}::double,{u}::double,{v}::double,{t}::double)" for i, (r, u, v, t) in enumerate(colour.LOCUS))
    return f"locus as (select i, r, u, v, 1/sqrt(1+t*t) as du, t/sqrt(1+t*t) as dv from (values {rows}) as z(i,r,u,v,t))"


def _kelvin_sql(code):
    return f"(case {code} " + " ".join(f"when {k} then {v}::double" for k, v in colour.KELVIN.items()) + " end)"


WITH_PROFILES = f"""profiles as (select clip, wx, wy, illum1, case when clip%3<>0 then 38-illum1 end as illum2, {_kelvin_sql('illum1')} as t1,
  {_kelvin_sql('case when clip%3<>0 then 38-illum1 end')} as t2, {_M1} as cm1, {_M2} as cm2, case when clip%2=0 then {_FM1} end as fm1, case when clip%2=0 then {_FM2} end as fm2,
  [0.5::double,1.0::double,0.6::double+m00/10] as neutral
  from (select {_K} as clip, 0.25::double+({_K}%100)*0.002::double as wx, 0.28::double+({_K}%90)*0.0015::double as wy, case when {_K}%2=0 then 17 else 21 end as illum1, 0.7::double+({_K}%10)*0.01::double as m00 from customer))"""


def _temp_tint_sql(source):
    """CTEs that end in tt(clip, kelvin, tint) for source(clip, wx, wy)."""
    return f"""{_locus_sql()}, uv as (select clip, 2*wx/(1.5::double-wx+6*wy) as u, 3*wy/(1.5::double-wx+6*wy) as v from {source}),
dts as (select uv.clip, uv.u as pu, uv.v as pv, l.*, (uv.v-l.v)*l.du-(uv.u-l.u)*l.dv as dt from uv, locus l),
prev as (select *, lag(dt) over w as ldt, lag(r) over w as lr, lag(u) over w as lu, lag(v) over w as lv, lag(du) over w as ldu, lag(dv) over w as ldv from dts window w as (partition by clip order by i)),
chosen as (select *, row_number() over (partition by clip order by i) as pick from prev where i>0 and (dt<=0 or i=30)),
ff as (select *, case when i=1 then 0::double else greatest(0::double,-dt)/(ldt+greatest(0::double,-dt)) end as f from chosen where pick=1),
mixed as (select *, ldu*f+du*(1-f) as mdu, ldv*f+dv*(1-f) as mdv from ff),
tt as (select clip, 1e6::double/(lr*f+r*(1-f)) as kelvin, -3000::double*((pu-(lu*f+u*(1-f)))*mdu+(pv-(lv*f+v*(1-f)))*mdv)/sqrt(mdu*mdu+mdv*mdv) as tint from mixed)"""


def _mul(a, b):
    return "[" + ",".join("+".join(f"{a}[{3 * i + n + 1}]*{b}[{3 * n + j + 1}]" for n in range(3)) for i in range(3) for j in range(3)) + "]"


def _vec(m, v):
    return "[" + ",".join("+".join(f"{m}[{3 * i + n + 1}]*{v}[{n + 1}]" for n in range(3)) for i in range(3)) + "]"


def _inv(m):
    e = lambda i, j: f"{m}[{3 * i + j + 1}]"
    det = f"({e(0, 0)}*({e(1, 1)}*{e(2, 2)}-{e(1, 2)}*{e(2, 1)})-{e(0, 1)}*({e(1, 0)}*{e(2, 2)}-{e(1, 2)}*{e(2, 0)})+{e(0, 2)}*({e(1, 0)}*{e(2, 1)}-{e(1, 1)}*{e(2, 0)}))"
    cell = lambda i, j: f"({e((j + 1) % 3, (i + 1) % 3)}*{e((j + 2) % 3, (i + 2) % 3)}-{e((j + 1) % 3, (i + 2) % 3)}*{e((j + 2) % 3, (i + 1) % 3)})/{det}"
    return "[" + ",".join(cell(i, j) for i in range(3) for j in range(3)) + "]"


def _lit(values):
    return "[" + ",".join(f"{float(v)!r}::double" for v in values) + "]"


_XYZ = "[{x}/{y},1::double,(1-{x}-{y})/{y}]"


def _lerp(a, b, t):
    return "[" + ",".join(f"{a}[{i}]+({b}[{i}]-{a}[{i}])*{t}" for i in range(1, 10)) + "]"


def _camera_sql(white):
    """CTEs that end in cam(clip, m)."""
    cct = "floor(-949.86315::double+6253.80338::double*exp(-n/0.92159::double)+28.70599::double*exp(-n/0.20039::double)+0.00004::double*exp(-n/0.07125::double)+0.5)"
    d50 = _XYZ.format(x="0.3457::double", y="0.3585::double")
    scaled = lambda: "[" + ",".join(f"back[{k + 1}]*ratio[{k % 3 + 1}]" for k in range(9)) + "]"
    neutral = _vec("xc", "white") if white == "D50" else _vec("finv", "white")
    forward = "[" + ",".join(f"fwd[{k + 1}]/(nt[{k % 3 + 1}]/list_max(nt))" for k in range(9)) + "]"
    last = "m" if white == "D50" else _mul("m", "d65")
    return f"""{WITH_PROFILES}, {_temp_tint_sql('profiles')}, {_ORDERED},
c1 as (select o.*, kelvin, (wx-0.3366::double)/(wy-0.1735::double) as n, {_XYZ.format(x='wx', y='wy')} as white, {d50} as d50, {_lit(colour.CONES)} as cones, {_lit(colour.CONES_INVERSE)} as back, {_lit(colour.D50_TO_D65)} as d65 from o join tt using (clip)),
c2 as (select *, {cct} as cct, case when t2 is null or kelvin<=t1 then 1 when kelvin>=t2 then 0 else (1/kelvin-1/t2)/(1/t1-1/t2) end::double as g, {_vec('cones', 'd50')} as w1, {_vec('cones', 'white')} as w2 from c1),
c3 as (select *, {_lerp('cm2', 'cm1', 'g')} as xc, [least(10::double,greatest(0.1::double,case when w1[i]>0 then greatest(0::double,w2[i])/w1[i] else 10 end)) for i in [1,2,3]] as ratio,
  (1/greatest(least(t1,t2),least(greatest(t1,t2),cct))-1/least(t1,t2))/(1/greatest(t1,t2)-1/least(t1,t2)) as ft from c2),
c4 as (select *, {scaled()} as sc, case when t2 is null then fm1 when t1<=t2 then {_lerp('fm1', 'fm2', 'ft')} else {_lerp('fm2', 'fm1', 'ft')} end as fwd from c3),
c5 as (select *, {_mul('sc', 'cones')} as adapt, {_inv('fwd')} as finv from c4),
c6 as (select *, {neutral} as nt, {_mul('xc', 'adapt')} as pcs from c5),
c7 as (select *, case when fm1 is not null then {forward} else {_inv('pcs')} end as m from c6),
cam as (select clip, {last} as m from c7)"""


_ORDERED = "o as (select clip, wx, wy, t1, t2, neutral, case when t1>t2 then cm2 else cm1 end as cm1, case when t1>t2 then cm1 else cm2 end as cm2, case when t1>t2 then fm2 else fm1 end as fm1, case when t1>t2 then fm1 else fm2 end as fm2 from profiles)"


def profiles(spark, d):
    k = F.col("c_custkey")
    m00 = F.lit(0.7) + (k % 10) * 0.01
    arr = lambda *v: F.array(*[x if not isinstance(x, float) else F.lit(x) for x in v])
    forward = lambda *v: F.when(k % 2 == 0, m3.literal(v))
    base = src.table(spark, d, "customer").select(
        k.alias("clip"),
        (F.lit(0.25) + (k % 100) * 0.002).alias("wx"),
        (F.lit(0.28) + (k % 90) * 0.0015).alias("wy"),
        F.when(k % 2 == 0, 17).otherwise(21).alias("illum1"),
        arr(m00, -0.2, -0.05, -0.4, 1.2, 0.2, -0.1, 0.2, 0.6).alias("color_matrix1"),
        arr(m00 + 0.05, -0.2, -0.05, -0.4, 1.25, 0.2, -0.1, 0.2, 0.65).alias("color_matrix2"),
        forward(0.45, 0.38, 0.13, 0.22, 0.72, 0.06, 0.02, 0.08, 0.72).alias("forward_matrix1"),
        forward(0.47, 0.36, 0.13, 0.24, 0.70, 0.06, 0.02, 0.06, 0.74).alias("forward_matrix2"),
        arr(0.5, 1.0, F.lit(0.6) + m00 / 10).alias("neutral"),
    )
    return base.withColumn("illum2", F.when(F.col("clip") % 3 != 0, F.lit(38) - F.col("illum1")))


def _nine(df, name, size=9):
    """One rounded column per element."""
    return df.select("clip", *[F.round(F.expr(f"{name}[{i}]"), 6).alias(f"m{i}") for i in range(size)])


def _nine_sql(name, source, size=9):
    return "select clip, " + ", ".join(f"round({name}[{i + 1}],6) as m{i}" for i in range(size)) + f" from {source}"


def _lights(spark, d):
    return src.table(spark, d, "customer").select(F.col(_K).alias("clip"), (F.lit(2000.0) + (F.col(_K) % 97) * 100).alias("kelvin"), ((F.col(_K) % 21) - 10).cast("double").alias("tint"))


def xyz_to_xy(spark, d):
    p = profiles(spark, d).withColumn("v", colour.xy_to_xyz(F.col("wx") * 2, F.col("wy")))
    x, y = colour.xyz_to_xy("v")
    return p.select("clip", x.alias("x"), y.alias("y"))


def map_white(spark, d):
    p = profiles(spark, d).withColumns({"a": colour.xy_to_xyz(F.lit(colour.D50[0]), F.lit(colour.D50[1])), "b": colour.xy_to_xyz(F.col("wx"), F.col("wy"))})
    return _nine(colour.with_map_white(p, "a", "b"), "map_white")


def as_shot(spark, d):
    """Single-light profiles by their neutral, every fifth clip by the recorded white, else daylight."""
    p = profiles(spark, d)
    p = p.withColumns({"neutral": F.when(F.col("clip") % 5 > 1, F.col("neutral")), "wx": F.when(F.col("clip") % 5 == 1, F.col("wx")), "wy": F.when(F.col("clip") % 5 == 1, F.col("wy")), "illum2": F.lit(None).cast("int")})
    return colour.as_shot_white(p, colour.neutral_to_xy(p)).select("clip", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _gamut(spark, d):
    names = list(colour.GAMUTS_D50)
    return colour.order_illuminants(profiles(spark, d)).withColumn("gamut", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("clip") % len(names) + 1).cast("int")))


def display(spark, d):
    p = _gamut(spark, d).withColumns({"m": colour.display_matrix(F.col("gamut")), "white": colour.xy_to_xyz(F.col("wx"), F.col("wy"))})
    return _nine(p.withColumn("v", m3.apply("m", "white")), "v", 3)


def params(spark, d):
    k = F.col("c_custkey")
    own = src.table(spark, d, "customer").select(
        k.alias("clip"),
        F.when(k % 3 == 0, (k % 7 - 3) / 2).alias("exposure"),
        F.when(k % 5 == 0, "LogC3").when(k % 7 == 0, "sRGB").alias("gamma"),
        F.when(k % 4 == 0, "None").alias("tone_map"),
        F.when(k % 6 == 0, "Off").alias("recovery"),
        F.when(k % 8 == 0, "Low").alias("rolloff"),
        F.when(k % 9 == 0, "Rec2020").alias("gamut"),
    )
    clips = src.clip_meta(spark, d).select("clip", (F.col("clip") % 50).alias("session"), F.col("clip").alias("opened"), "baseline_exposure")
    return colour.effective_params(clips, own)


def _normalised(spark, d):
    out = colour.with_normalised(profiles(spark, d), apply_scale=True)
    return out.select("clip", *[F.round(F.expr(f"color_norm[{i}]"), 6).alias(f"c{i}") for i in (0, 4, 8)], *[F.round(F.expr(f"forward_norm[{i}]"), 6).alias(f"f{i}") for i in (0, 4, 8)])


_NAMES = list(colour.GAMUTS_D50)
_DISPLAY = "(case clip%5 " + " ".join(f"when {i} then {_lit(colour.GAMUTS_D50[n])}" for i, n in enumerate(_NAMES)) + " end)"


def _locus_xy_sql(source):
    """CTEs that end in xy(clip, x, y) for source(clip, kelvin, tint)."""
    return f"""{_locus_sql()}, pairs as (select i, r, u, v, du, dv, lead(r) over w as r2, lead(u) over w as u2, lead(v) over w as v2, lead(du) over w as du2, lead(dv) over w as dv2 from locus window w as (order by i)),
hit as (select s.clip, s.tint, p.*, (r2-1e6::double/kelvin)/(r2-r) as f from {source} s join pairs p on p.r2 is not null and (p.i=0 or 1e6::double/kelvin>=p.r) and (p.i=29 or 1e6::double/kelvin<p.r2)),
ax as (select *, du*f+du2*(1-f) as a, dv*f+dv2*(1-f) as b from hit),
pt as (select clip, u*f+u2*(1-f)+a/sqrt(a*a+b*b)*tint/-3000 as pu, v*f+v2*(1-f)+b/sqrt(a*a+b*b)*tint/-3000 as pv from ax),
xy as (select clip, 1.5::double*pu/(pu-4*pv+2) as x, pv/(pu-4*pv+2) as y from pt)"""


WITH_LIGHTS = f"lights as (select {_K} as clip, 2000::double+({_K}%97)*100 as kelvin, (({_K}%21)-10)::double as tint from customer)"

QUERIES = {
    "h1_illuminant_kelvin": lambda s, d: src.table(s, d, "customer").select(F.col(_K).alias("clip"), colour.illuminant_kelvin(F.col(_K) % 25).cast("long").alias("kelvin")),
    "h2_xyz_to_xy": xyz_to_xy,
    "h4_temp_tint": lambda s, d: colour.with_temp_tint(profiles(s, d), "wx", "wy").select("clip", F.round("kelvin", 3).alias("kelvin"), F.round("tint", 4).alias("tint")),
    "h5_temp_tint_to_xy": lambda s, d: colour.with_xy_of_temp_tint(_lights(s, d), "kelvin", "tint").select("clip", F.round("x", 6).alias("x"), F.round("y", 6).alias("y")),
    "h6_order_illuminants": lambda s, d: _nine(colour.order_illuminants(profiles(s, d)), "color_matrix1"),
    "h7_xyz_to_camera": lambda s, d: _nine(colour.with_xyz_to_camera(colour.order_illuminants(profiles(s, d))), "xyz_to_camera"),
    "h8_neutral_to_xy": lambda s, d: colour.neutral_to_xy(colour.order_illuminants(profiles(s, d))).select("clip", F.round("x", 5).alias("x"), F.round("y", 5).alias("y")),
    "h9_as_shot_white": as_shot,
    "h10_map_white": map_white,
    "h11_camera_to_xyz_d50": lambda s, d: _nine(colour.with_camera_to_xyz(colour.order_illuminants(profiles(s, d))), "camera_to_xyz"),
    "h12_camera_to_xyz_d65": lambda s, d: _nine(colour.with_camera_to_xyz(colour.order_illuminants(profiles(s, d)), white="D65"), "camera_to_xyz"),
    "h13_display_matrix": display,
    "h14_camera_white": lambda s, d: _nine(colour.with_camera_white(_gamut(s, d), "gamut").withColumn("both", F.concat("white_max", "white_min")), "both", 6),
    "h15_normalise_matrix": _normalised,
    "h15_temp_tint_offset": lambda s, d: _nine(colour.with_temp_tint_offset(profiles(s, d), 300.0, 5.0), "color_offset"),
    "h16_effective_params": params,
    "h16_presets": lambda s, d: colour.presets(src.clip_meta(s, d)),
}

ORACLES = {
    "h1_illuminant_kelvin": f"select {_K} as clip, {_kelvin_sql(_K + '%25')}::bigint as kelvin from customer",
    "h2_xyz_to_xy": f"with {WITH_PROFILES}, c as (select clip, wx*2 as x, wy as y, least(1::double, 0.999999::double/(wx*2+wy)) as f from profiles) select clip, case when f<1 then x*f else x end as x, case when f<1 then y*f else y end as y from c",
    "h4_temp_tint": f"with {WITH_PROFILES}, {_temp_tint_sql('profiles')} select clip, round(kelvin,3) as kelvin, round(tint,4) as tint from tt",
    "h5_temp_tint_to_xy": f"with {WITH_LIGHTS}, {_locus_xy_sql('lights')} select clip, round(x,6) as x, round(y,6) as y from xy",
    "h6_order_illuminants": f"with {WITH_PROFILES}, {_ORDERED} {_nine_sql('cm1', 'o')}",
    "h7_xyz_to_camera": f"with {WITH_PROFILES}, {_temp_tint_sql('profiles')}, {_ORDERED}, x as (select o.*, case when t2 is null or kelvin<=t1 then 1 when kelvin>=t2 then 0 else (1/kelvin-1/t2)/(1/t1-1/t2) end::double as g from o join tt using (clip)), y as (select clip, {_lerp('cm2', 'cm1', 'g')} as m from x) {_nine_sql('m', 'y')}",
    "h9_as_shot_white": f"with {WITH_PROFILES}, day as (select 0 as clip, 5500::double as kelvin, 10::double as tint), {_locus_xy_sql('day')}, n as (select p.*, {_inv('cm1')} as ci from profiles p), v as (select n.*, {_vec('ci', 'neutral')} as w from n) select v.clip, round(case when v.clip%5>1 then w[1]/(w[1]+w[2]+w[3]) when v.clip%5=1 then wx else xy.x end,6) as x, round(case when v.clip%5>1 then w[2]/(w[1]+w[2]+w[3]) when v.clip%5=1 then wy else xy.y end,6) as y from v, xy",
    "h10_map_white": f"with {WITH_PROFILES}, a as (select clip, {_lit(colour.CONES)} as cones, {_XYZ.format(x='0.3457::double', y='0.3585::double')} as d50, {_XYZ.format(x='wx', y='wy')} as white from profiles), b as (select clip, cones, {_inv('cones')} as back, {_vec('cones', 'd50')} as w1, {_vec('cones', 'white')} as w2 from a), c as (select *, [least(10::double,greatest(0.1::double,case when w1[i]>0 then greatest(0::double,w2[i])/w1[i] else 10 end)) for i in [1,2,3]] as ratio from b), e as (select clip, cones, [back[k+1]*ratio[k%3+1] for k in range(9)] as sc from c), f as (select clip, {_mul('sc', 'cones')} as m from e) {_nine_sql('m', 'f')}",
    "h11_camera_to_xyz_d50": f"with {_camera_sql('D50')} {_nine_sql('m', 'cam')}",
    "h12_camera_to_xyz_d65": f"with {_camera_sql('D65')} {_nine_sql('m', 'cam')}",
    "h13_display_matrix": f"with {WITH_PROFILES}, a as (select clip, {_DISPLAY} as m, {_XYZ.format(x='wx', y='wy')} as white from profiles), b as (select clip, {_vec('m', 'white')} as v from a) {_nine_sql('v', 'b', 3)}",
    "h14_camera_white": f"with {_camera_sql('D50')}, a as (select clip, m, {_DISPLAY} as dm from cam), b as (select clip, {_mul('dm', 'm')} as q from a), c as (select clip, {_inv('q')} as q from b), e as (select clip, [q[1]+q[2]+q[3], q[4]+q[5]+q[6], q[7]+q[8]+q[9]] as w from c), f as (select clip, list_concat([x/list_max(w) for x in w], [x/list_min(w) for x in w]) as v from e) {_nine_sql('v', 'f', 6)}",
    "h15_normalise_matrix": f"with {WITH_PROFILES}, a as (select clip, cm1, fm1, {_XYZ.format(x='0.3457::double', y='0.3585::double')} as d from profiles), b as (select *, list_max({_vec('cm1', 'd')}) as top from a), c as (select *, case when top>0 and (top<0.99 or top>1.01) then top else 1 end as k from b) select clip, round(cm1[1]/k,6) as c0, round(cm1[5]/k,6) as c4, round(cm1[9]/k,6) as c8, round(fm1[1]*d[1]/(fm1[1]+fm1[2]+fm1[3]),6) as f0, round(fm1[5]*d[2]/(fm1[4]+fm1[5]+fm1[6]),6) as f4, round(fm1[9]*d[3]/(fm1[7]+fm1[8]+fm1[9]),6) as f8 from c",
    "h16_presets": f"""with clip_meta as ({src.CLIP_META}), w as (select * from (values ('as shot', null, null), ('shade', 7500, 10), ('cloud', 6500, 10), ('daylight', 5500, 10), ('fluorescent', 3800, 21), ('tungsten', 3200, 0)) as t(preset, kelvin, tint)),
e as (select * from (values ('as shot', null), ('minus two', -2), ('minus one', -1), ('zero', 0), ('plus one', 1), ('plus two', 2)) as t(preset, stops))
select clip, 'white balance' as kind, preset, kelvin::double as kelvin, tint::double as tint, null::double as exposure from clip_meta, w
union all select clip, 'exposure', preset, null, null, round_even(coalesce(baseline_exposure,0),0)+stops::double from clip_meta, e""",
    "h16_effective_params": f"""with clip_meta as ({src.CLIP_META}), own as (select {_K} as clip, case when {_K}%3=0 then ({_K}%7-3)/2::double end as exposure, case when {_K}%5=0 then 'LogC3' when {_K}%7=0 then 'sRGB' end as gamma, {_K} as k from customer),
j as (select m.clip, m.baseline_exposure, own.exposure, own.gamma, own.k from clip_meta m left join own on own.clip=m.clip)
select clip, coalesce(exposure, baseline_exposure, 0)::double as exposure, coalesce(last_value(gamma ignore nulls) over (partition by clip%50 order by clip rows unbounded preceding), 'Rec709') as gamma,
 case when k%4=0 then 'None' else 'SDR' end as tone_map, case when k%6=0 then 'Off' else 'On' end as recovery, case when k%8=0 then 'Low' else 'Medium' end as rolloff, case when k%9=0 then 'Rec2020' else 'Rec709' end as gamut,
 (round_even(coalesce(baseline_exposure,0),0)-2)::bigint as lowest_preset, (round_even(coalesce(baseline_exposure,0),0)+2)::bigint as highest_preset from j""",
}
