"""Queries that trace the blobs of masks and measure the traced contours."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from leafspark.operators import blob_texture, contours, shape, texture
from leafspark.plans import flow
from leafspark.plans.catalog_blobs import CT, HI1, HI2, HULL, LO1, LO2, SLOPE
from leafspark.plans.catalog_images import EXG_BYTE, LABELS, OTSU, SIZE, green_mask
from leafspark.plans.catalog_pixels import HSI, HSV, LAB, UNIT, YCC
from leafspark.plans.registry import query, r6

# The walk round a blob, side by side: sides 0 to 3 face left, down, right, up; corners and pixels ahead decide the next.
WALK = LABELS + """, wk(image_id, blob_id, k, x, y, s) as (select distinct image_id, label, 0, label%8, label//8, 0 from lb union all
 select w.image_id, w.blob_id, w.k+1, w.x+case when a.p is not null then dx+ox when b.p is not null then dx else 0 end,
 w.y+case when a.p is not null then dy+oy when b.p is not null then dy else 0 end, case when a.p is not null then (s+3)%4 when b.p is not null then s else (s+1)%4 end
 from (select *, [0,1,0,-1][s+1] dx, [1,0,-1,0][s+1] dy, [-1,0,1,0][s+1] ox, [0,1,0,-1][s+1] oy from wk where not (k>0 and x=blob_id%8 and y=blob_id//8 and s=0)) w
 left join mk a on a.image_id=w.image_id and a.x=w.x+dx+ox and a.y=w.y+dy+oy left join mk b on b.image_id=w.image_id and b.x=w.x+dx and b.y=w.y+dy),
 vs as (select *, lag(x) over w lx, lag(y) over w ly from wk window w as (partition by image_id, blob_id order by k)),
 ps as (select *, count(*) over p n, row_number() over (partition by image_id, blob_id order by k) j from vs where k=0 or x<>lx or y<>ly window p as (partition by image_id, blob_id)),
 traced as materialized (select image_id, blob_id, cast(j-1 as int) i, cast(x as int) x, cast(y as int) y, n-cast(n>1 as int) n from ps where j=1 or j<n)"""
MEASURED = WALK + CT.replace("from contours ", "from traced ")
KEY = ["image_id", "blob_id"]
EDGE = f"(x=0 or x+w>={SIZE})"


def small_id(df):
    """Blob ids of 8 x 8 images: the first pixel's place."""
    return df.withColumn("blob_id", (F.shiftright("blob_id", 31) * SIZE + F.col("blob_id").bitwiseAND((1 << 31) - 1)).cast("int"))


def traced(v):
    return small_id(contours.contours(contours.find_blobs(green_mask(v))))


query("seg5_contours", "pixels", WALK + " select image_id, blob_id, i, x, y from traced")(
    lambda v: small_id(contours.contour_points(contours.find_blobs(green_mask(v)))))
query("seg5_component_pixels", "pixels", LABELS + " select image_id, p%8 x, p//8 y, label blob_id from lb")(
    lambda v: small_id(contours.find_blobs(green_mask(v))))
query("shp1_to_7_from_mask", "pixels", MEASURED + f""" select image_id, blob_id, {r6('per')} perimeter, {r6('ar')} area,
 {r6(f'case when {EDGE} then 0.0 when ar=0 then null else per/(sqrt(ar)*4) end')} shape_index,
 {r6(f'case when {EDGE} then 0.0 when n=1 then null when {LO1}=0 then null else {HI1}/{LO1} end', 3)} lw_ratio, {r6(f'case when per=0 then null else ar*{4 * math.pi!r}/(per*per) end')} compactness,
 {r6('w/cast(h as double)')} elongation, {r6(f'case when {HI2}=0 then 0.0 else sqrt(greatest({LO2},0.0)/{HI2}) end')} eccentricity from sh""")(
    lambda v: shape.shape_factors(traced(v), SIZE).withColumn("lw_ratio", F.round("lw_ratio", 3)))
query("shp8_9_from_mask", "pixels", MEASURED + HULL.removeprefix(CT).replace("from contours)", "from traced)") + f""" select sh.image_id, sh.blob_id, {r6('coalesce(hp,0.0)')} hull_perimeter,
 {r6('coalesce(ha,0.0)')} hull_area, {r6(f'case when coalesce(hp,0)=0 then null else ar*{4 * math.pi!r}/(hp*hp) end')} roundness, {r6('case when per=0 then null else hp/per end')} convexity,
 {r6('case when coalesce(ha,0)=0 then null else ar/ha end')} solidity from sh left join hs using (image_id, blob_id)""")(
    lambda v: shape.hull_factors(traced(v)))
query("shp10_chain_from_mask", "pixels", WALK + """, c1 as (select *, lead(x) over w nx, lead(y) over w ny from traced window w as (partition by image_id, blob_id order by i))
 select image_id, blob_id, coalesce(string_agg([3,2,1,4,99,0,5,6,7][1+3*(case when y<ny then 0 when y>ny then 2 else 1 end)
 +(case when x>nx then 0 when x<nx then 2 else 1 end)], ',' order by i) filter (nx is not null), '') chain from c1 group by all""")(
    lambda v: traced(v).select(*KEY, F.concat_ws(",", F.transform(shape.chain_code(F.col("contour")), lambda c: c.cast("string"))).alias("chain")))
AT = "join traced {0} on {0}.image_id=c.image_id and {0}.blob_id=c.blob_id and {0}.i=((c.i{1})%c.n+c.n)%c.n"
query("shp11_k_slope_from_mask", "pixels", WALK + f""" select c.image_id, c.blob_id, c.i as "i", {r6(SLOPE.format('p', 'q'))} kslope
 from traced c {AT.format('p', '+3')} {AT.format('q', '-3')} where (c.i-2)%6=0 and c.i>=2 and c.i<=c.n-5""")(
    lambda v: traced(v).select(*KEY, F.posexplode(shape.k_slope(F.col("contour"), 6)).alias("n", "kslope")).select(*KEY, (F.col("n") * 6 + 2).alias("i"), "kslope"))
CURVE = f""", kc as (select c.image_id, c.blob_id, c.i, (a.x-b.x)/6.0 f1x, (a.y-b.y)/6.0 f1y, (a.x-2*c.x+b.x)/36.0 f2x, (a.y-2*c.y+b.y)/36.0 f2y
 from traced c {AT.format('a', '+6')} {AT.format('b', '-6')}),
 cv as (select image_id, blob_id, i, sqrt(4*pow(f2y*f1x-f2x*f1y,2)/(pow(f1x*f1x+f1y*f1y,3)+1e-11+1e-12)) k from kc)"""
query("shp12_k_curvature_from_mask", "pixels", WALK + f"{CURVE} select image_id, blob_id, i, {r6('k')} kcurvature from cv")(
    lambda v: traced(v).select(*KEY, F.posexplode(shape.k_curvature(F.col("contour"), 6)).alias("i", "kcurvature")))
query("shp13_bending_from_mask", "pixels", WALK + f"{CURVE} select image_id, blob_id, {r6('avg(k*k)', 3)} bending, {r6('avg(abs(k))', 3)} abscurvature from cv group by all", 3)(
    lambda v: shape.bending(traced(v), 6))
query("shp14_radial_from_mask", "pixels", WALK + f""", r0 as (select *, floor(avg(x) over p) mx, floor(avg(y) over p) my from traced window p as (partition by image_id, blob_id)),
 r1 as (select image_id, blob_id, sqrt(pow(x-mx,2)+pow(y-my,2)) d from r0), r2 as (select *, d/nullif(max(d) over (partition by image_id, blob_id), 0) nd from r1),
 r3 as (select *, round(avg(nd) over (partition by image_id, blob_id), 12) m from r2)
 select image_id, blob_id, {r6('max(d)')} radial_max, {r6('avg(nd)')} radial_avg, {r6('var_pop(nd)')} radial_var,
 {r6('count(*) filter (round(nd,12)>m)/cast(count(*) as double)')} radial_crossings_pct from r3 group by all""")(
    lambda v: shape.radial(traced(v)))

# The factor flow: blobs over the Otsu threshold of the index, their pixels, and every band as rows.
FLOW = OTSU.format(band=EXG_BYTE, src="pixels") + LABELS.replace(
    "from pixels where 2*g-r-b>0", f"from (select p.image_id, x, y, {EXG_BYTE} e, threshold from pixels p join ot on p.image_id=ot.image_id) where e>threshold") + """,
 pb as materialized (select lb.image_id, label blob_id, pixels.x, pixels.y, r, g, b from lb join pixels on lb.image_id=pixels.image_id and lb.p=pixels.y*8+pixels.x)"""
FLOW_BANDS = {"greyscale": "yy", "yiq_y": UNIT[0], "yiq_i": UNIT[1], "yiq_q": UNIT[2], "hsv_hue": "hsv.h", "hsv_saturation": "hsv.s", "value": "hsv.v", "hsi_hue": "hsi.h", "hsi_saturation": "hsi.s",
              "hsi_intensity": "hsi.i", "blue": "pb.b", "green": "pb.g", "red": "pb.r", "ycbcr_y": "yy", "ycbcr_cb": "cb", "ycbcr_cr": "cr", "cie_l": "cie_l", "cie_a": "cie_a", "cie_b": "cie_b"}


def _of(text):
    """The text with its plain band names taken from the blob pixels."""
    return text.replace("r/255", "pb.r/255").replace("g/255", "pb.g/255").replace("b/255", "pb.b/255") if "/255" in text else text


PLACE = "{0}.image_id=pb.image_id and {0}.x=pb.x and {0}.y=pb.y"
BAND_ROWS = FLOW + HSV + YCC + LAB + HSI + f""", bl as materialized (select pb.image_id, blob_id, pb.x, pb.y, unnest([{','.join(repr(n) for n in FLOW_BANDS)}]) band,
 unnest([{','.join(f'cast({_of(t)} as double)' for t in FLOW_BANDS.values())}]) v, unnest([{','.join(str(n.startswith(('yiq', 'hsi'))).lower() for n in FLOW_BANDS)}]) f
 from pb join hsv on {PLACE.format('hsv')} join ycc on {PLACE.format('ycc')} join lab on {PLACE.format('lab')} join hsi on {PLACE.format('hsi')})"""
query("flow_geometry", "pixels", BAND_ROWS + f""", q as (select image_id, blob_id, count(*) area, min(x) x, min(y) y, max(x)-min(x)+1 w, max(y)-min(y)+1 h, floor(avg(y)) cy from pb group by all),
 tn as (select image_id, blob_id, avg(nullif(v,0)) filter (band='hsv_hue') hue, avg(nullif(v,0)) filter (band='hsv_saturation') sm, stddev_pop(nullif(v,0)) filter (band='yiq_i') ip,
 avg(nullif(v,0)) filter (band='ycbcr_cb') cb from bl group by all)
 select image_id, blob_id, area, x, y, w, h, {r6('area/cast(max(area) over (partition by image_id) as double)')} size_ratio, {r6('w/cast(h as double)')} elongation, {r6('hue')} hue, {r6('sm')} saturation_mean,
 {r6('ip')} in_phase, {r6('cb')} cb_mean, {r6('abs(cy-4)/8.0')} normalized_distance, case when x=0 or x+w>=8 then 1 else 0 end reason,
 row_number() over (partition by image_id order by blob_id)-1 "number" from q join tn using (image_id, blob_id)""")(
    lambda v: small_id(flow.image_factors(v.pixels).select(*KEY, "area", "x", "y", "w", "h", "size_ratio", "elongation", "hue", "saturation_mean", "in_phase", "cb_mean", "normalized_distance", "reason", "number")))
query("flow_glcm", "pixels", BAND_ROWS + f""", lo as (select *, min(v) over w mn, max(v) over w mx from bl window w as (partition by image_id, blob_id, band)),
 lv as materialized (select image_id, blob_id, x, y, band, case when not f then v when mx=mn then 0 else floor((v-mn)/(mx-mn)) end v from lo),
 gm as (select a.image_id, a.blob_id, a.band, ang angle, a.v i, b.v j, count(*) n from lv a cross join (values ('0',1,0),('45',1,1),('90',0,1),('135',-1,1),('180',-1,0)) o(ang,dx,dy)
 join lv b on a.image_id=b.image_id and a.blob_id=b.blob_id and a.band=b.band and b.x=a.x+dx and b.y=a.y+dy group by all),
 gp as (select *, n/cast(sum(n) over (partition by image_id, blob_id, band, angle) as double) p from gm),
 gu as (select *, sum(i*p) over w mi, sum(j*p) over w mj from gp window w as (partition by image_id, blob_id, band, angle)),
 ga as (select image_id, blob_id, band, angle, sum(p*p) asm, sum(p*(i-j)*(i-j)) contrast, sum(p*abs(i-j)) dis, sum(p/(1+(i-j)*(i-j))) hom,
 sum(p*(i-mi)*(j-mj)) cov, sqrt(sum(p*(i-mi)*(i-mi))) si, sqrt(sum(p*(j-mj)*(j-mj))) sj from gu group by all)
 select image_id, blob_id, band, {r6('avg(sqrt(asm))')} energy, {r6('avg(contrast)')} contrast, {r6('avg(dis)')} dissimilarity, {r6('avg(hom)')} homogeneity, {r6('avg(asm)')} "ASM",
 {r6('avg(case when si<1e-9 or sj<1e-9 then 1.0 else cov/(si*sj) end)')} correlation from ga group by all""")(lambda v: small_id(glcm_rows(v)))


def glcm_rows(v):
    """The co-occurrence factors of the flow, one row for each blob and band; blobs without two neighbours have none."""
    rows = F.array(*[F.struct(F.lit(band).alias("band"), *[F.col(f"{band}_{p}_avg").alias(p) for p in texture.PROPERTIES]) for band in blob_texture.NAMES])
    return flow.image_factors(v.pixels).select(*KEY, F.inline(rows)).filter("energy is not null")
