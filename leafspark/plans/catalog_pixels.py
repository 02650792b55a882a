"""Queries over pixel and depth tables: colour spaces, vegetation indices, masks, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafspark.functions import color, indices, rules, scalars
from leafspark.operators import images
from leafspark.plans.registry import query, r6

KEY = ["image_id", "x", "y"]

BYTE = "cast(least(greatest(floor({}+0.5),0),255) as int)"
GREY = BYTE.format("(r*0.299+g*0.587+b*0.114)")
HSV_H = """cast(case when greatest(r,g,b)=least(r,g,b) then 0
 when greatest(r,g,b)=r then floor((g-b)*30.0/(greatest(r,g,b)-least(r,g,b))+0.5)
 when greatest(r,g,b)=g then floor((b-r)*30.0/(greatest(r,g,b)-least(r,g,b))+60+0.5)
 else floor((r-g)*30.0/(greatest(r,g,b)-least(r,g,b))+120+0.5) end as int)"""
HSV = f""", h0 as (select image_id, x, y, r, g, b, {HSV_H} hh,
 cast(case when greatest(r,g,b)=0 then 0 else floor((greatest(r,g,b)-least(r,g,b))*255.0/greatest(r,g,b)+0.5) end as int) s,
 greatest(r,g,b) v from pixels), hsv as (select * exclude (hh), case when hh<0 then hh+180 else hh end h from h0)"""
YCC = f""", y0 as (select *, {GREY} yy from pixels), ycc as (select image_id, x, y, r, g, b, yy,
 {BYTE.format('((r-yy)*0.713+128)')} cr, {BYTE.format('((b-yy)*0.564+128)')} cb from y0)"""
LIN = "case when {0}/255.0<=0.04045 then {0}/255.0/12.92 else pow(({0}/255.0+0.055)/1.055,2.4) end"
BEND = "(case when {0}>0.008856 then cbrt({0}) else {0}*7.787+16.0/116.0 end)"
LAB = f""", l0 as (select image_id, x, y, r, g, b, {LIN.format('r')} lr, {LIN.format('g')} lg, {LIN.format('b')} lb from pixels),
 l1 as (select *, (lr*0.412453+lg*0.357580+lb*0.180423)/0.950456 cx, (lr*0.212671+lg*0.715160+lb*0.072169)/1.0 cy,
 (lr*0.019334+lg*0.119193+lb*0.950227)/1.088754 cz from l0),
 lab as (select image_id, x, y, {BYTE.format("(case when cy>0.008856 then cbrt(cy)*116-16 else cy*903.3 end)*255.0/100.0")} cie_l,
 {BYTE.format(f"(({BEND.format('cx')}-{BEND.format('cy')})*500+128)")} cie_a,
 {BYTE.format(f"(({BEND.format('cy')}-{BEND.format('cz')})*200+128)")} cie_b from l1)"""


def pixelwise(name, columns, sql_columns, prefix="", source="pixels", places=6):
    """A query that only adds columns to every pixel."""
    text = ", ".join(f"{expression} as {alias}" for alias, expression in sql_columns.items())
    query(name, "pixels", f"{prefix} select image_id, x, y, {text} from {source}", places)(
        lambda v: v.pixels.select(*KEY, *[c.alias(n) for n, c in columns(*v.rgb).items()]))


YIQ_SQL = ["(r*0.299+g*0.587+b*0.114)", "(r*0.59590059+g*(-0.27455667)+b*(-0.32134392))",
           "(r*0.21153661+g*(-0.52273617)+b*0.31119955)"]
UNIT = [t.replace("r*", "r/255.0*").replace("g*", "g/255.0*").replace("b*", "b/255.0*") for t in YIQ_SQL]

pixelwise("col1_yiq_bytes", lambda R, G, B: color.yiq_bytes(R, G, B), {
    n: f"cast(((round_even({e}{s},0)%256)+256)%256 as int)"
    for n, e, s in zip(["yiq_y", "yiq_i", "yiq_q"], YIQ_SQL, ["", "+128", "+128"])})
pixelwise("col2_yiq", lambda R, G, B: color.yiq(R, G, B), {n: r6(e) for n, e in zip(["yiq_y", "yiq_i", "yiq_q"], UNIT)})
pixelwise("col4_hsv", lambda R, G, B: color.hsv(R, G, B), {"hsv_hue": "h", "hsv_saturation": "s", "value": "v"}, HSV, "hsv")
pixelwise("col5_ycbcr", lambda R, G, B: color.ycbcr(R, G, B), {"ycbcr_y": "yy", "ycbcr_cb": "cb", "ycbcr_cr": "cr"}, YCC, "ycc")
pixelwise("col6_cielab", lambda R, G, B: color.cielab(R, G, B), {"cie_l": "cie_l", "cie_a": "cie_a", "cie_b": "cie_b"}, LAB, "lab")
pixelwise("col7_yuv", lambda R, G, B: color.yuv(R, G, B), {"yuv_y": "yy", "yuv_u": BYTE.format("((b-yy)*0.492+128)"),
                                            "yuv_v": BYTE.format("((r-yy)*0.877+128)")}, YCC, "ycc")
pixelwise("col8_greyscale", lambda R, G, B: {"grey": color.grey(R, G, B)}, {"grey": GREY})

HSI = """, i0 as (select *, bool_or(g>b) over (partition by image_id) anyg, ((r-g)*(r-g)+(r-b)*(g-b))::double q from pixels),
 i1 as (select *, degrees(acos(least(greatest(((r-g)+(r-b))*0.5/(case when q=0 then 1.0 else sqrt(q) end),-1.0),1.0))) a,
 case when least(r,g,b)=0 then 0.00001 else least(r,g,b) end lo, case when r+g+b=0 then 0.00001 else r+g+b end t from i0),
 hsi as (select image_id, x, y, case when anyg then a else 360-a end h, 1-lo*3/t s, (r+g+b)/3.0 i from i1)"""
query("col3_hsi", "pixels", f"{HSI} select image_id, x, y, {r6('h')} hsi_hue, {r6('s')} hsi_saturation, {r6('i')} hsi_intensity from hsi")(
    lambda v: images.hsi(v.pixels).drop("r", "g", "b"))

query("col9_normalise", "pixels", f""", m as (select *, r/cast(max(r) over w as double) nr, g/cast(max(g) over w as double) ng,
 b/cast(max(b) over w as double) nb from pixels window w as (partition by image_id))
 select image_id, x, y, {r6('nr/(nr+ng+nb+1e-5)')} red, {r6('ng/(nr+ng+nb+1e-5)')} green, {r6('nb/(nr+ng+nb+1e-5)')} blue from m""")(
    lambda v: images.normalise_bands(v.pixels).drop("r", "g", "b"))
query("col9_normalise_compat", "pixels", f""", m as (select *, r/cast(max(r) over w as double) nr, g/cast(max(g) over w as double) ng,
 b/cast(max(b) over w as double) nb from pixels window w as (partition by image_id)),
 m1 as (select *, nr/(nr+ng+nb+1e-5) red from m), m2 as (select *, ng/(red+ng+nb+1e-5) green from m1)
 select image_id, x, y, {r6('red')} red, {r6('green')} green, {r6('nb/(red+green+nb+1e-5)')} blue from m2""")(
    lambda v: images.normalise_bands(v.pixels, compat=True).drop("r", "g", "b"))
query("col10_stretch", "pixels", f""", e as (select *, cast(2*g-r-b as double) e from pixels),
 m as (select *, min(e) over w lo, max(e) over w hi from e window w as (partition by image_id))
 select image_id, x, y, {r6('case when hi=lo then 0.0 else (e-lo)*255.0/(hi-lo) end')} stretched from m""")(
    lambda v: images.stretch(v.pixels, indices.exg(*v.rgb), "stretched", 255.0).drop("r", "g", "b"))
EQ = """, hh as (select image_id, {band} v, count(*) n from {src} group by all),
 hc as (select *, sum(n) over (partition by image_id order by v) cdf, sum(n) over (partition by image_id) total,
 first_value(n) over (partition by image_id order by v) first from hh),
 eq as (select image_id, v, cast(case when total=first then v else floor((cdf-first)*255.0/(total-first)+0.5) end as int) q from hc)"""
query("col11_equalise", "pixels", EQ.format(band="greatest(r,g,b)", src="pixels") + """
 select p.image_id, x, y, q equalised from pixels p join eq on p.image_id=eq.image_id and greatest(r,g,b)=eq.v""")(
    lambda v: images.equalise(v.pixels, F.greatest(*v.rgb), "equalised").drop("r", "g", "b"))
query("col12_compose", "pixels", f""", m as (select *, least(max(r) over w/1000.0,0.4) t, min(r) over w/1000.0 mr, min(g) over w/1000.0 mg,
 min(b) over w/1000.0 mb from pixels window w as (partition by image_id)) select image_id, x, y,
 {r6('least(greatest(mr+r/1000.0/t,0.0),1.0)')} r_scaled, {r6('least(greatest(mg+g/1000.0/t,0.0),1.0)')} g_scaled,
 {r6('least(greatest(mb+b/1000.0/t,0.0),1.0)')} b_scaled from m""")(
    lambda v: images.compose(v.pixels, 1000.0).drop("r", "g", "b"))

# Index texts.
EXG, EXR = "(g*2-r-b)", "(r*1.3-g)"
CIVE = "(r*0.441-g*0.811+b*0.385+18.78745)"
VEG = f"(case when pow(r,0.667)*pow(b,{1 - 0.667!r})=0 then 0.0 else g/(pow(r,0.667)*pow(b,{1 - 0.667!r})) end)"
INDEX_SQL = {
    "ndi": "(case when g+r=0 then 0.0 else ((g-r)/cast(g+r as double)+1)*128 end)", "tgi": "(g-r*0.52-b*0.59)",
    "exg": f"cast({EXG} as double)", "exr": EXR, "exgexr": f"({EXG}-{EXR})", "cive": CIVE,
    "ngrdi": "(case when g+r=0 then 0.0 else (g-r)/cast(g+r as double) end)", "veg": VEG,
    "com1": f"({EXG}+{CIVE}+({EXG}-{EXR})+{VEG})", "mexg": "(g*1.262-r*0.884-b*0.311)",
    "com2": f"({EXG}*0.36+{CIVE}*0.47+{VEG}*0.17)"}
for number, name in enumerate(["ndi", "tgi", "exg", "exr", "exgexr", "cive", "ngrdi", "veg", "com1", "mexg", "com2"], 1):
    pixelwise(f"idx{number}_{name}", lambda R, G, B, name=name: {"value": indices.index(name, R, G, B)}, {"value": r6(f"cast({INDEX_SQL[name]} as double)", 8)}, places=8)
query("idx3_exg_long", "pixels_long", f"select image_id, {r6('avg(' + EXG + ')')} exg_mean, {r6('max(cast(' + CIVE + ' as double))')} cive_max, count(*) n from pixels_long group by image_id")(
    lambda v: v.pixels_long.groupBy("image_id").agg(F.avg(indices.exg(*v.rgb)).alias("exg_mean"),
                                                    F.max(indices.cive(*v.rgb)).alias("cive_max"), F.count(F.lit(1)).alias("n")))

DI = """, d1 as (select *, avg(mm) over w mean from depth window w as (partition by frame_id)),
 d2 as (select *, case when mm=0 then mean else mm end f from d1),
 di as (select frame_id, x, y, case when max(f) over w=min(f) over w then 0.0 else (max(f) over w-f)/(max(f) over w-min(f) over w) end di
 from d2 window w as (partition by frame_id))"""
query("idx12_depth_index", "depth", f"{DI} select frame_id, x, y, {r6('di')} di from di")(
    lambda v: images.depth_index(v.depth).drop("mm"))
query("idx13_refine", "depth", f"{DI} select image_id, p.x, p.y, {r6('greatest(' + EXG + '*di,0.0)')} \"value\" from pixels p join di on image_id=frame_id and p.x=di.x and p.y=di.y")(
    lambda v: images.refine(v.pixels.select(*KEY, indices.exg(*v.rgb).alias("value")), v.depth))
pixelwise("idx14_si", lambda R, G, B: {"value": indices.si(R, G, B)},
          {'"value"': "case when h between 100 and 140 and s>=130 and v>=130 then 255 else 0 end"}, HSV, "hsv")
RGD_SQL = """case when (h between 40 and 80 and s>=100 and v>=100) or (h=0 and s>=100 and v>=20)
 or (h between 160 and 179 and s>=100 and v>=20) then 255 else 0 end"""
pixelwise("idx15_rgd", lambda R, G, B: {"value": indices.rgd(R, G, B)}, {'"value"': RGD_SQL}, HSV, "hsv")
RANGES = "(values " + ", ".join(f"('{n}',{a},{b},{c},{d},{e},{f})" for n, a, b, c, d, e, f in indices.COLOR_RANGES) + ") t(color,h0,s0,v0,h1,s1,v1)"
query("idx16_color_names", "pixels", f"{HSV} select image_id, x, y, color from hsv join {RANGES} on h between h0 and h1 and s between s0 and s1 and v between v0 and v1")(
    lambda v: v.pixels.select(*KEY, F.explode(indices.color_names(*v.rgb)).alias("color")))
pixelwise("idx16_lid_mask", lambda R, G, B: {"value": indices.lid_mask(R, G, B)},
          {'"value"': "case when h between 90 and 128 and s between 90 and 255 and v between 70 and 255 then 255 else 0 end"}, HSV, "hsv")
pixelwise("idx17_pipes", lambda R, G, B: {"pipe": indices.pipes(R, G, B), "pipe_compat": indices.pipes(R, G, B, True)},
          {"pipe": "cb<=cr", "pipe_compat": "cr<=cb"}, YCC, "ycc")
pixelwise("idx18_yi", lambda R, G, B: {"value": indices.yi(R, G, B)}, {'"value"': r6(f"case when {UNIT[2]}<0.04 then {UNIT[2]} else 0.0 end")})
HSI_PIXEL = HSI.replace("case when anyg then a else 360-a end h", "a h")
pixelwise("idx19_hi", lambda R, G, B: {"value": indices.hi(R, G, B)},
          {'"value"': r6("(case when h>=190 or h<=55 then 0.0 else h end)+(case when s<=0.45 then 0.0 else s end)+(case when i>=50 then 0.0 else i end)")},
          HSI_PIXEL, "hsi")
query("idx20_hv", "pixels", HSV + EQ.format(band="v", src="hsv") + f""", g0 as (select hsv.image_id, x, y,
 case when h>=50 or h<=30 then 0 else h end gh, case when s<=20 then 0 else s end gs, q from hsv join eq on hsv.image_id=eq.image_id and hsv.v=eq.v),
 g1 as (select *, min(q) over w vl, max(q) over w vh, min(gs) over w sl, max(gs) over w sh from g0 window w as (partition by image_id, x))
 select image_id, x, y, {r6('gh*(case when vh=vl then 0.0 else (q-vl)/cast(vh-vl as double) end)')} hv,
 {r6('case when sh=sl then 0.0 else (gs-sl)/cast(sh-sl as double) end')} s_scaled from g1""")(
    lambda v: images.hv(v.pixels).drop("r", "g", "b"))
pixelwise("idx21_ci", lambda R, G, B: {"value": indices.ci(R, G, B)},
          {'"value"': r6("cast(case when cie_b-cie_a<30 then 0 else cie_b-cie_a end as double)")}, LAB, "lab")
YCCI = "(case when cr=0 then 0.0 else log2(cast(abs(cr) as double))*cb end)"
YCCI = f"(case when {YCCI}>=890 then 0.0 else {YCCI} end)"
pixelwise("idx22_ycbcri", lambda R, G, B: {"value": indices.ycbcri(R, G, B)}, {'"value"': r6(YCCI)}, YCC, "ycc")
UHSV = """, u as (select image_id, x, y, greatest(r,g,b) mx, greatest(r,g,b)-least(r,g,b) d, r, g, b from pixels),
 uh as (select *, case when d=0 then 0.0 when mx=r then case when g<b then (g-b)*60.0/d+360 else (g-b)*60.0/d end
 when mx=g then (b-r)*60.0/d+120 else (r-g)*60.0/d+240 end h, case when mx=0 then 0.0 else d*1.0/mx end s, mx/255.0 v from u)"""
pixelwise("idx23_dgci", lambda R, G, B: {"value": indices.dgci(R, G, B)}, {'"value"': r6("((h-60)/60+(1-s)+(1-v))/3")}, UHSV, "uh")
HEX = """, n0 as (select image_id, x, y, r/255.0 r, g/255.0 g, b/255.0 b from pixels),
 n1 as (select *, greatest(r,g,b) pk, greatest(r,g,b)+0.00001 mx, greatest(r,g,b)+0.00001-least(r,g,b) d from n0),
 n2 as (select *, case when pk=r then (g-b)/d*60 when pk=g then ((b-r)*d+2.0)*60 else ((r-g)*d+4.0)*60 end h from n1)"""
pixelwise("idx24_dgci_hexcone", lambda R, G, B: {"value": indices.dgci_hexcone(R, G, B)}, {'"value"': r6("((h-60)/60+(1-d/mx)+(1-mx))/3")}, HEX, "n2")
SCALE = "case when {0} is null or {0}<-1 or {0}>1 then {1} else cast(trunc({0}*10000) as int) end"
NDVI_V, EVI2_V = "(case when ni+rd=0 then null else (ni-rd)/(ni+rd) end)", "((ni-rd)*2.5/(ni+rd*2.4+1.0))"
EVI2_S = SCALE.format(EVI2_V, -13000)
EVI_V = "((ni-rd)/(ni+rd*6.0-bl*7.5+1.0)*2.5)"
NIRB = f", nb as (select image_id, x, y, r/255.0 rd, g/255.0 ni, b/255.0 bl from pixels)"
pixelwise("idx25_satellite", lambda R, G, B: {"ndvi": indices.ndvi(R / 255.0, G / 255.0), "evi2": indices.evi2(R / 255.0, G / 255.0),
                              "evi": indices.evi(R / 255.0, G / 255.0, B / 255.0)},
          {"ndvi": SCALE.format(NDVI_V, -13000), "evi2": EVI2_S,
           "evi": f"case when bl>0 and bl<1 and ni>rd and rd>bl and ni+rd*6.0-bl*7.5+1.0<>0 then {SCALE.format(EVI_V, EVI2_S)} else {EVI2_S} end"}, NIRB, "nb")
ALL_SQL = {**INDEX_SQL, "rgd": RGD_SQL, "si": "case when h between 100 and 140 and s>=130 and v>=130 then 255 else 0 end"}
query("idx26_dispatch", "pixels", f"{HSV} {YCC.replace('from pixels)', 'from hsv)').replace('r, g, b, yy', 'r, g, b, h, s, v, yy')}, a as ("
      + " union all ".join(f"select image_id, '{n}' as \"index\", cast({e} as double) val from ycc" for n, e in {**ALL_SQL, "ycbcri": YCCI}.items())
      + f") select image_id, \"index\", {r6('avg(val)', 9)} mean, {r6('max(val)', 9)} top, count(*) n from a group by all", 9)(
    lambda v: images.index_summary(v.pixels))
query("idx26_all_rows", "pixels_long", " select image_id, 'exg' as \"index\", count(*) n from pixels_long group by image_id")(
    lambda v: images.all_indices(v.pixels_long.withColumn("y", F.lit(0))).filter("index = 'exg'").groupBy("image_id", "index").agg(F.count(F.lit(1)).alias("n")))

# Masks and filters on pixels.
pixelwise("flt1_threshold", lambda R, G, B: {"above": rules.threshold_mask(indices.exg(R, G, B), 50), "below": rules.threshold_mask(indices.exg(R, G, B), 50, -1),
                             "negated": rules.threshold_mask(indices.exg(R, G, B), 50, 1, True)},
          {"above": f"cast({EXG}>50 as int)", "below": f"cast({EXG}<50 as int)", "negated": f"cast(not {EXG}>50 as int)"})
pixelwise("flt2_two_thresholds", lambda R, G, B: {"mask": rules.two_threshold_mask(indices.exg(R, G, B), 100, -100)},
          {"mask": f"cast({EXG}>100 or {EXG}<-100 as int)"})
pixelwise("flt3_apply_mask", lambda R, G, B: dict(zip(
    ["red", "green", "blue"], rules.apply_mask(rules.threshold_mask(indices.exg(R, G, B), 50), R, G, B))),
          {n: f"{c}*cast({EXG}>50 as int)" for n, c in zip(["red", "green", "blue"], "rgb")})
query("flt12_depth_threshold", "depth", """, c as (select frame_id, x, y, case when mm=65535 or mm>2500 then 0 else mm end m from depth)
 select frame_id, x, y, case when m=0 then max(m) over (partition by frame_id) else m end mm from c""")(
    lambda v: images.clean_depth(v.depth, 2500))
query("flt13_depth_smooth", "depth", """, c as (select *, stddev_pop(case when mm>0 then mm end) over (partition by frame_id) sd,
 lead(mm) over (partition by frame_id, y order by x) nx from depth)
 select frame_id, x, y, case when x<6 and y<7 and abs(mm-nx)<sd then 0 else mm end mm from c""")(
    lambda v: images.smooth_depth(v.depth))
pixelwise("flt14_value_list", lambda R, G, B: {"masked": rules.value_list_mask(G, R % 8, [0, 2, 5]).cast("int")},
          {"masked": "case when r%8 in (0,2,5) then g else -13000 end"})
query("flt17_transect", "pixels", """, t as (select * from pixels where y=3 and x between 2 and 6)
 select image_id, max(g) peak, arg_max(x, g*100-x) peak_x, min(g) low, count(*) n from t group by image_id""")(
    lambda v: images.transect(v.pixels, "g", 3, 2, 5))
query("flt18_subset", "pixels", "select image_id, x, y, r, g, b from pixels where x>=1 and x<5 and y>=2 and y<6")(
    lambda v: v.pixels.filter(rules.inside_box(F.col("x"), F.col("y"), 1, 2, 4, 4)))
query("flt18_blob_crop", "pixels blobs", f""" select p.image_id, blob_id, count(*) n, {r6('avg(g)')} g_mean
 from blobs k join pixels p on k.image_id=p.image_id and p.x>=k.x and p.x<k.x+k.w and p.y>=k.y and p.y<k.y+k.h group by all""")(
    lambda v: images.crop_blobs(v.pixels, v.blobs).groupBy("image_id", "blob_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("g").alias("g_mean")))
pixelwise("flt20_binarise", lambda R, G, B: {"cartoon": rules.binarise(color.grey(R, G, B))}, {"cartoon": f"case when {GREY}>0 then 255 else {GREY} end"})
pixelwise("scl15_lut_class", lambda R, G, B: {"class": scalars.lut_class(G, [(0, 63), (64, 127), (128, 200)])},
          {'"class"': "case when g<=63 then 0 when g<=127 then 1 when g<=200 then 2 else -1 end"})
query("jn13_depth_subset", "depth", """ select frame_id, x, y, mm, cast(floor((x-1)/0.5) as int) rgb_x, cast(floor((y-1)/0.5) as int) rgb_y
 from depth where x>=1 and x<7 and y>=1 and y<6""")(
    lambda v: images.depth_subset(v.depth, (2, 2), (10, 2), (2, 2), (6, 2), (12, 10)))
