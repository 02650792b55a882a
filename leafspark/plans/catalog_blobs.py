"""Queries over blob boxes and contours: rules, plane joins, shape and position factors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from leafspark.functions import rules, scalars
from leafspark.operators import plane, shape
from leafspark.operators.grouped import with_group_stats
from leafspark.plans.registry import query, r6

WIDTH, HEIGHT = 640, 480
KEY = ["image_id", "blob_id"]


def coarse(blobs):
    """Twenty orders to one image, so that images hold many blobs."""
    return blobs.withColumns({"blob_id": F.col("blob_id") * 20 + F.col("image_id") % 20,
                              "image_id": F.floor(F.col("image_id") / 20)})


CB = ", cb as (select * exclude (image_id, blob_id), image_id//20 image_id, blob_id*20+image_id%20 blob_id from blobs)"

query("flt5_min_area", "blobs", " select image_id, blob_id, area from blobs where area>500")(
    lambda v: v.blobs.filter(F.col("area") > 500).select(*KEY, "area"))
query("flt6_edge_rule", "blobs", f""" select image_id, blob_id, case when x=0 or x+w>={WIDTH} then 4 else "type" end "type",
 case when x=0 or x+w>={WIDTH} then 1 else 0 end reason from blobs""")(
    lambda v: v.blobs.select(*KEY, F.when(rules.at_edge(F.col("x"), F.col("w"), WIDTH), rules.UNKNOWN).otherwise(F.col("type")).alias("type"),
                             F.when(rules.at_edge(F.col("x"), F.col("w"), WIDTH), rules.REASON_AT_EDGE).otherwise(0).alias("reason")))


@query("flt7_size_ratio", "blobs", f""", m as (select *, max(area) over (partition by image_id) big, (x=0 or x+w>={WIDTH}) edge from blobs)
 select image_id, blob_id, case when "type"<>4 or edge then "type" when big>4*area then 1 else 0 end "type",
 case when "type"<>4 then 0 when edge then 1 else 2 end reason from m""")
def _(v):
    b = with_group_stats(v.blobs, ["image_id"], largest=F.max("area"))
    rule = rules.size_ratio_type(b.type, b.area, b.largest, rules.at_edge(b.x, b.w, WIDTH), 4)
    return b.select(*KEY, *[c.alias(n) for n, c in rule.items()])


query("flt8_force_class", "blobs", " select image_id, blob_id, 1 as \"type\", 'Undesired' as label from blobs")(
    lambda v: v.blobs.select(*KEY, F.lit(rules.UNDESIRED).alias("type"), rules.label(F.lit(rules.UNDESIRED)).alias("label")))
query("flt15_crop_row", "blobs", " select image_id, blob_id from blobs where cy>40 and cy<440")(
    lambda v: v.blobs.filter(rules.crop_row_candidate(F.col("cy"), HEIGHT)).select(*KEY))


def lids(v):
    return coarse(v.blobs).filter("type = 0").select("image_id", F.col("blob_id").alias("lid_id"), F.col("cx").alias("lx"), F.col("cy").alias("ly"))


@query("jn2_nearest_blob", "blobs", CB + f""", l as (select image_id, blob_id lid_id, cx lx, cy ly from cb where "type"=0),
 c as (select l.image_id, lid_id, blob_id, (lx-cx)*(lx-cx)+(ly-cy)*(ly-cy) d2 from l join cb on l.image_id=cb.image_id and cb."type"<>0),
 w as (select *, row_number() over (partition by image_id, lid_id order by d2, blob_id) n from c where d2<999*999)
 select l.image_id, l.lid_id, blob_id, {r6('sqrt(cast(d2 as double))')} distance from l left join w on l.image_id=w.image_id and l.lid_id=w.lid_id and n=1""")
def _(v):
    return plane.nearest_blob(lids(v), coarse(v.blobs).filter("type <> 0"))


@query("jn3_lid_contains", "blobs", CB + """, l as (select image_id, blob_id lid_id, cx x, cy y, w*2 r from cb where "type"=0),
 s as (select image_id, cx sx, cy sy, w//10 sr from cb where "type"=1)
 select l.image_id, lid_id, count(sx) stickers from l left join s on l.image_id=s.image_id and r>sr
 and (x-sx)*(x-sx)+(y-sy)*(y-sy)<(r-sr)*(r-sr) group by all""")
def _(v):
    b = coarse(v.blobs)
    large = b.filter("type = 0").select("image_id", F.col("blob_id").alias("lid_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), (F.col("w") * 2).alias("r"))
    small = b.filter("type = 1").select("image_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.floor(F.col("w") / 10).cast("int").alias("r"))
    return plane.stickers_in_lids(large, small)


query("jn4_lid_at_blob", "blobs", CB + """ select l.image_id, l.blob_id lid_id, b.blob_id from cb l join cb b on l.image_id=b.image_id
 and l."type"=0 and b."type"<>0 and abs(l.cx-b.cx)<=10 and abs(l.cy-b.cy)<=10""")(
    lambda v: plane.lids_at_blobs(lids(v), coarse(v.blobs).filter("type <> 0")))

ANGLE = "(case when a.cx=b.cx and a.cy=b.cy then 0.0 when a.cx=b.cx then 90.0 else degrees(atan(abs(a.cy-b.cy)/cast(abs(a.cx-b.cx) as double))) end)"
LEVEL = CB + f""", ce as (select * from cb where "type" not in (1,3)), lc as (select a.image_id, a.blob_id, a.cx, a.cy,
 count(*) filter ({ANGLE}<=5) lvl, count(*) filter ({ANGLE}>5) off_level
 from ce a join ce b on a.image_id=b.image_id group by all)"""
query("jn6_center_angles", "blobs", LEVEL + ' select image_id, blob_id, cx, cy, lvl as "level", off_level from lc')(
    lambda v: plane.level_counts(coarse(v.blobs).filter(~F.col("type").isin(1, 3)).select(*KEY, "cx", "cy")))
query("pos3_crop_line", "blobs", LEVEL + f""", f as (select *, row_number() over (partition by image_id order by off_level, blob_id) n from lc),
 g as (select *, row_number() over (partition by image_id order by abs({HEIGHT // 2}-cy), n) k from f where n<=5)
 select image_id, blob_id, cy crop_y, off_level from g where k=1""")(
    lambda v: plane.crop_line(coarse(v.blobs), HEIGHT))
query("seg7_overlap", "blobs", CB + """ select image_id, blob_id, case when exists (select 1 from cb b where b.image_id=a.image_id and
 b.blob_id<>a.blob_id and a.cx>=b.x and a.cx<b.x+b.w and a.cy>=b.y and a.cy<b.y+b.h) then 3 else "type" end "type" from cb a""")(
    lambda v: plane.ignore_overlaps(coarse(v.blobs)).select(*KEY, "type"))
query("pos1_leading_edge", "blobs", f" select image_id, blob_id, {r6(f'({WIDTH}-x)*0.37')} as \"leading\" from blobs")(
    lambda v: plane.leading_edge(v.blobs, WIDTH, 0.37).select(*KEY, "leading"))
query("pos2_crop_distance", "blobs", f" select image_id, blob_id, abs(cy-{HEIGHT // 2}) distance, {r6(f'abs(cy-{HEIGHT // 2})/cast({HEIGHT} as double)')} normalized_distance from blobs")(
    lambda v: plane.crop_distances(v.blobs, HEIGHT // 2, HEIGHT).select(*KEY, "distance", "normalized_distance"))
VOTES = CB + ", a as (select * from (values " + ", ".join(f"({a},{math.cos(math.radians(a))!r}::double,{math.sin(math.radians(a))!r}::double)" for a in range(180)) + """) t(theta,c,s)),
 vt as (select image_id, theta, cast(floor(cx*c+cy*s+0.5) as int) rho, count(*) votes from cb, a group by all)"""
query("pos4_row_votes", "blobs", VOTES + """, k as (select *, row_number() over (partition by image_id order by votes desc, theta, rho) place from vt)
 select image_id, theta, rho, votes, place from k where place<=3""")(
    lambda v: plane.best_lines(plane.row_votes(coarse(v.blobs).select("image_id", "cx", "cy"), best=3), 3))


@query("pos5_treatment_plan", "blobs pixels", """, wd as (select image_id, x%8 x, y%8 y, least(w,8-x%8) w, least(h,8-y%8) h from blobs where "type"=1),
 c as (select distinct image_id, (8-(y+2*j))//2+1 as "row", (x+2*i)//2 as "col" from wd, range(4) a(i), range(4) b(j) where 2*i<w and 2*j<h),
 g as (select distinct image_id, cast(ceil((8-y)/2.0) as int) as "row", x//2 as "col" from pixels where 2*g-r-b>50)
 select image_id, cast("row" as int) "row", cast("col" as int) "col", 1 "type" from c semi join g using (image_id, "row", "col")""")
def _(v):
    b = v.blobs.withColumns({"x": F.col("x") % 8, "y": F.col("y") % 8})
    b = b.withColumns({"w": F.least(b.w, 8 - b.x), "h": F.least(b.h, 8 - b.y)})
    p = v.pixels
    mask = p.select("image_id", "x", "y", rules.threshold_mask(p.g * 2 - p.r - p.b, 50).alias("v"))
    return plane.treatment_plan(b, mask, 8, 2)


@query("pos6_square_cover", "pixels", """, s as (select image_id, x//2 cx, y//2 cy, count(*) n from pixels where 2*g-r-b>0 group by all)
 select image_id, cx*2 x, cy*2 y from s where n=4""")
def _(v):
    p = v.pixels
    return plane.full_squares(p.filter(p.g * 2 - p.r - p.b > 0), 2, keys=("image_id",))


# Shape factors.
CT = """, c1 as (select *, coalesce(lead(x) over w, first_value(x) over w) nx, coalesce(lead(y) over w, first_value(y) over w) ny
 from contours window w as (partition by image_id, blob_id order by i)),
 m0 as (select *, avg(x) over p mx, avg(y) over p my from c1 window p as (partition by image_id, blob_id)),
 sh as (select image_id, blob_id, count(*) n, sum(sqrt(pow(nx-x,2)+pow(ny-y,2))) per, abs(sum(x*ny-nx*y))/2.0 ar,
 min(x) x, max(x)-min(x)+1 w, max(y)-min(y)+1 h, sum(pow(x-mx,2)) sxx, sum(pow(y-my,2)) syy, sum((x-mx)*(y-my)) sxy from m0 group by all)"""
EDGE = f"(x=0 or x+w>={WIDTH})"


def eigen(c):
    root = f"sqrt(pow((sxx/n-syy/n)/2,2)+{c}*{c})"
    return f"((sxx/n+syy/n)/2+{root})", f"((sxx/n+syy/n)/2-{root})"


HI1, LO1 = eigen("(sxy/(n-1))")
HI2, LO2 = eigen("(sxy/n)")
SHAPES = {
    "shp1_perimeter": ("perimeter", "per"), "shp2_area": ("area", "ar"),
    "shp3_shape_index": ("shape_index", f"case when {EDGE} then 0.0 when ar=0 then null else per/(sqrt(ar)*4) end"),
    "shp4_length_width": ("lw_ratio", f"case when {EDGE} then 0.0 when {LO1}=0 then null else {HI1}/{LO1} end"),
    "shp5_compactness": ("compactness", f"case when per=0 then null else ar*{4 * math.pi!r}/(per*per) end"),
    "shp6_elongation": ("elongation", "w/cast(h as double)"),
    "shp7_eccentricity": ("eccentricity", f"case when {HI2}=0 then 0.0 else sqrt(greatest({LO2},0.0)/{HI2}) end")}
for name, (column, text) in SHAPES.items():
    query(name, "contours", f"{CT} select image_id, blob_id, {r6(text)} {column} from sh")(
        lambda v, column=column: shape.shape_factors(v.contours, WIDTH).select(*KEY, column))

HULL = CT + """, d as (select distinct image_id, blob_id, x, y from contours),
 ed as (select a.image_id, a.blob_id, a.x ax, a.y ay, b.x bx, b.y by_ from d a join d b on a.image_id=b.image_id and a.blob_id=b.blob_id and (a.x<>b.x or a.y<>b.y)),
 hu as (select * from ed e where not exists (select 1 from d k where k.image_id=e.image_id and k.blob_id=e.blob_id and
 ((bx-ax)*(k.y-ay)-(by_-ay)*(k.x-ax)<0 or ((bx-ax)*(k.y-ay)-(by_-ay)*(k.x-ax)=0 and
 ((k.x-ax)*(bx-ax)+(k.y-ay)*(by_-ay)<0 or (k.x-ax)*(bx-ax)+(k.y-ay)*(by_-ay)>(bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)))))),
 hs as (select image_id, blob_id, sum(sqrt(pow(bx-ax,2)+pow(by_-ay,2))) hp, abs(sum(ax*by_-bx*ay))/2.0 ha from hu group by all)"""
query("shp8_convex_hull", "contours", HULL + f" select image_id, blob_id, {r6('hp')} hull_perimeter, {r6('ha')} hull_area from hs")(
    lambda v: shape.hull_factors(v.contours).select(*KEY, "hull_perimeter", "hull_area"))
query("shp9_hull_factors", "contours", HULL + f""" select image_id, blob_id, {r6(f'ar*{4 * math.pi!r}/(hp*hp)')} roundness,
 {r6('hp/per')} convexity, {r6('ar/ha')} solidity from sh join hs using (image_id, blob_id)""")(
    lambda v: shape.hull_factors(v.contours).select(*KEY, "roundness", "convexity", "solidity"))
query("shp10_chain_code", "contours", """, c1 as (select *, lead(x) over w nx, lead(y) over w ny from contours window w as (partition by image_id, blob_id order by i))
 select image_id, blob_id, string_agg([3,2,1,4,99,0,5,6,7][1+3*(case when y<ny then 0 when y>ny then 2 else 1 end)
 +(case when x>nx then 0 when x<nx then 2 else 1 end)], ',' order by i) chain from c1 where nx is not null group by all""")(
    lambda v: v.contours.select(*KEY, F.concat_ws(",", F.transform(shape.chain_code(F.col("contour")), lambda c: c.cast("string"))).alias("chain")))
AT = "join contours {0} on {0}.image_id=c.image_id and {0}.blob_id=c.blob_id and {0}.i=(c.i{1}+24)%24"
SLOPE = "(case when {0}.y={1}.y then 0.0 else atan(({0}.x-{1}.x)/cast({0}.y-{1}.y as double)) end)"
query("shp11_k_slope", "contours", f""" select c.image_id, c.blob_id, c.i as "i", {r6(SLOPE.format('p', 'q'))} kslope
 from contours c {AT.format('p', '+3')} {AT.format('q', '-3')} where (c.i-2)%6=0 and c.i>=2 and c.i<20""")(
    lambda v: v.contours.select(*KEY, F.posexplode(shape.k_slope(F.col("contour"), 6)).alias("n", "kslope"))
    .select(*KEY, (F.col("n") * 6 + 2).alias("i"), "kslope"))
CURVE = f""", kc as (select c.image_id, c.blob_id, c.i, (a.x-b.x)/6.0 f1x, (a.y-b.y)/6.0 f1y, (a.x-2*c.x+b.x)/36.0 f2x, (a.y-2*c.y+b.y)/36.0 f2y
 from contours c {AT.format('a', '+6')} {AT.format('b', '-6')}),
 cv as (select image_id, blob_id, i, sqrt(4*pow(f2y*f1x-f2x*f1y,2)/(pow(f1x*f1x+f1y*f1y,3)+1e-11+1e-12)) k from kc)"""
query("shp12_k_curvature", "contours", f"{CURVE} select image_id, blob_id, i, {r6('k')} kcurvature from cv")(
    lambda v: v.contours.select(*KEY, F.posexplode(shape.k_curvature(F.col("contour"), 6)).alias("i", "kcurvature")))
query("shp12_k_curvature_approximate", "contours", f""" select c.image_id, c.blob_id, c.i as "i", {r6(SLOPE.format('b', 'c') + '-' + SLOPE.format('c', 'a'))} kcurvature
 from contours c {AT.format('a', '+6')} {AT.format('b', '-6')} where (c.i-5)%6=0 and c.i>=5 and c.i<17""")(
    lambda v: v.contours.select(*KEY, F.posexplode(shape.k_curvature_approximate(F.col("contour"), 6)).alias("n", "kcurvature"))
    .select(*KEY, (F.col("n") * 6 + 5).alias("i"), "kcurvature"))
query("shp13_bending", "contours", f"{CURVE} select image_id, blob_id, {r6('avg(k*k)')} bending, {r6('avg(abs(k))')} abscurvature from cv group by all")(
    lambda v: shape.bending(v.contours, 6))
query("shp14_radial", "contours", f""", r0 as (select *, floor(avg(x) over p) mx, floor(avg(y) over p) my from contours window p as (partition by image_id, blob_id)),
 r1 as (select image_id, blob_id, sqrt(pow(x-mx,2)+pow(y-my,2)) d from r0), r2 as (select *, d/max(d) over (partition by image_id, blob_id) nd from r1),
 r3 as (select *, avg(nd) over (partition by image_id, blob_id) m from r2)
 select image_id, blob_id, {r6('max(d)')} radial_max, {r6('avg(nd)')} radial_avg, {r6('var_pop(nd)')} radial_var,
 {r6('count(*) filter (nd>m)/cast(count(*) as double)')} radial_crossings_pct from r3 group by all""")(
    lambda v: shape.radial(v.contours))
query("agg20_blob_geometry", "pixels", f""", m as (select image_id, y//4 blob_id, x, y from pixels where 2*g-r-b>0),
 q as (select image_id, blob_id, count(*) area, min(x) x, min(y) y, max(x)-min(x)+1 w, max(y)-min(y)+1 h,
 cast(floor(avg(x)) as int) cx, cast(floor(avg(y)) as int) cy from m group by all)
 select *, {r6('area/cast(max(area) over (partition by image_id) as double)')} size_ratio from q""")(
    lambda v: shape.blob_geometry(v.pixels.filter("2 * g - r - b > 0").select(
        "image_id", F.floor(F.col("y") / 4).cast("int").alias("blob_id"), "x", "y")))
query("agg21_blob_bands", "pixels", f""" select image_id, y//4 blob_id, {r6('avg(nullif(g,0))')} g_mean, {r6('stddev_pop(nullif(g,0))')} g_stddev,
 {r6('avg(nullif(b,0))')} b_mean, {r6('stddev_pop(nullif(b,0))')} b_stddev from pixels group by all""")(
    lambda v: shape.blob_bands(v.pixels.withColumn("blob_id", F.floor(F.col("y") / 4).cast("int")), {"g": F.col("g"), "b": F.col("b")}))
query("scl6_size_and_mm", "blobs", f""" select image_id, blob_id, {r6('area/cast(max(area) over (partition by image_id) as double)')} size_ratio,
 cast(trunc((cx-x)*0.37) as int) mm from blobs""")(
    lambda v: with_group_stats(v.blobs, ["image_id"], big=F.max("area")).select(
        *KEY, (F.col("area") / F.col("big")).alias("size_ratio"), scalars.mm_between(F.col("x"), F.col("cx"), 0.37).alias("mm")))
query("scl12_grid", "blobs", f""" select image_id, blob_id, cast(floor(({HEIGHT}-cy)/80.0) as int)+1 as "row", cx//80 as "col",
 cx//80*80 as "left", {HEIGHT}-(cast(floor(({HEIGHT}-cy)/80.0) as int)+1)*80 as top from blobs""")(
    lambda v: v.blobs.select(*KEY, *[c.alias(n) for n, c in scalars.grid_cell(F.col("cx"), F.col("cy"), HEIGHT, 80).items()])
    .select("*", *[c.alias(n) for n, c in scalars.grid_corner(F.col("row"), F.col("col"), HEIGHT, 80).items()]))
