"""Queries that run neighbourhood operators on images: thresholds, morphology, components, texture."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafspark.functions import color, indices, rules
from leafspark.operators import shape, stencil, texture
from leafspark.plans.registry import query, r6

SIZE = 8
GREY_SQL = "cast(least(greatest(floor((r*0.299+g*0.587+b*0.114)+0.5),0),255) as int)"
EXG_BYTE = "((2*g-r-b)%256+256)%256"


def grey(v):
    return v.pixels.select("image_id", "x", "y", color.grey(*v.rgb).alias("v"))


def exg_byte(v):
    return v.pixels.select("image_id", "x", "y", F.pmod(indices.exg(*v.rgb).cast("int"), F.lit(256)).alias("v"))


def green_mask(v):
    return v.pixels.select("image_id", "x", "y", rules.threshold_mask(indices.exg(*v.rgb), 0).alias("v"))


OTSU = """, ob as (select image_id, {band} v, count(*) n from {src} group by all),
 oc as (select *, cast(sum(n) over w as double) cn, cast(sum(n*v) over w as double) cs, cast(sum(n) over p as double) tn, cast(sum(n*v) over p as double) ts
 from ob window w as (partition by image_id order by v), p as (partition by image_id)),
 od as (select *, case when cn=tn then -1.0 else round((ts*cn-cs*tn)*(ts*cn-cs*tn)/(cn*(tn-cn)),3) end score, case when cn=tn then 0 else v end lvl from oc),
 ot as (select image_id, lvl threshold from (select *, row_number() over (partition by image_id order by score desc, lvl) k from od) where k=1)"""

query("flagship_vegetation_share", "pixels", OTSU.format(band=EXG_BYTE, src="pixels") + f""" select p.image_id, any_value(threshold) threshold,
 {r6(f'avg(case when {EXG_BYTE}>threshold then 1.0 else 0.0 end)')} vegetation from pixels p join ot on p.image_id=ot.image_id group by p.image_id""")(
    lambda v: vegetation_share(exg_byte(v)))


def vegetation_share(index):
    """Share of pixels over the image's Otsu threshold. Both come from the histogram: one scan, one shuffle."""
    return stencil.otsu_bins(index, F.col("v")).groupBy("image_id", "threshold").agg(
        (F.sum(F.when(F.col("v") > F.col("threshold"), F.col("n")).otherwise(0)) / F.sum("n")).alias("vegetation"))


query("seg1_otsu", "pixels", OTSU.format(band=GREY_SQL, src="pixels") + " select * from ot")(lambda v: stencil.otsu(grey(v), F.col("v")))


@query("seg2_triangle", "pixels", f""", tb as (select image_id, {GREY_SQL} v, count(*) n from pixels group by all),
 td as (select i.image_id, lvl, coalesce(n,0) n from (select distinct image_id from tb) i cross join range(256) t(lvl) left join tb on tb.image_id=i.image_id and tb.v=lvl),
 tp as (select image_id, greatest(min(lvl) filter (n>0)-1,0) l, least(max(lvl) filter (n>0)+1,255) r, arg_max(lvl, n*1000-lvl) pk, max(n) top from td group by image_id),
 tf as (select *, pk-l<r-pk flip from tp), tg as (select image_id, flip, top, case when flip then 255-r else l end l, case when flip then 255-pk else pk end pk from tf),
 th as (select tg.image_id, flip, l, case when flip then 255-lvl else lvl end i, top*(case when flip then 255-lvl else lvl end)+(l-pk)*n d, pk from tg join td on tg.image_id=td.image_id),
 ti as (select image_id, any_value(flip) flip, coalesce(arg_max(i, d*1000-i) filter (d>0 and i>l and i<=pk), any_value(l))-1 t from th group by image_id)
 select image_id, cast(case when flip then 255-t else t end as int) threshold from ti""")
def _(v):
    return stencil.triangle(grey(v), F.col("v"))


MORPH = """, mk as (select image_id, x, y, cast(2*g-r-b>0 as int) v from pixels),
 dl as (select a.image_id, a.x, a.y, max(b.v) v from mk a join mk b on a.image_id=b.image_id and abs(a.x-b.x)<=1 and abs(a.y-b.y)<=1 group by all)"""
query("seg3_dilate", "pixels", MORPH + " select * from dl")(lambda v: stencil.morphology(green_mask(v), SIZE, SIZE, 3))
query("seg3_erode", "pixels", MORPH + " select a.image_id, a.x, a.y, min(b.v) v from mk a join mk b on a.image_id=b.image_id and abs(a.x-b.x)<=1 and abs(a.y-b.y)<=1 group by all")(
    lambda v: stencil.morphology(green_mask(v), SIZE, SIZE, 3, grow=False))
query("seg3_close", "pixels", MORPH + " select a.image_id, a.x, a.y, min(b.v) v from dl a join dl b on a.image_id=b.image_id and abs(a.x-b.x)<=1 and abs(a.y-b.y)<=1 group by all")(
    lambda v: stencil.close_mask(green_mask(v), SIZE, SIZE, 3))
query("seg4_blur", "pixels", f""", gk as (select * from (values (-3,2),(-2,7),(-1,14),(0,18),(1,14),(2,7),(3,2)) t(d,w)),
 gr as (select image_id, x, y, {GREY_SQL} v from pixels), tg as (select a.image_id, a.x, a.y, kx.w*ky.w w,
 case when a.x+kx.d<0 then -(a.x+kx.d) when a.x+kx.d>7 then 14-(a.x+kx.d) else a.x+kx.d end sx,
 case when a.y+ky.d<0 then -(a.y+ky.d) when a.y+ky.d>7 then 14-(a.y+ky.d) else a.y+ky.d end sy from gr a, gk kx, gk ky)
 select tg.image_id, tg.x, tg.y, cast(floor(sum(v*w)/4096.0+0.5) as int) v from tg join gr on tg.image_id=gr.image_id and gr.x=sx and gr.y=sy group by all""")(
    lambda v: stencil.blur(grey(v), SIZE, SIZE))
LABELS = """, mk as materialized (select image_id, y*8+x p, x, y from pixels where 2*g-r-b>0),
 fl(image_id, p, label) as (select image_id, p, p from mk union select b.image_id, b.p, f.label from fl f
 join mk a on a.image_id=f.image_id and a.p=f.p join mk b on b.image_id=a.image_id and abs(a.x-b.x)<=1 and abs(a.y-b.y)<=1 and b.p>f.label),
 lb as (select image_id, p, min(label) label from fl group by all)"""




@query("seg5_components", "pixels", LABELS + """, cs as (select image_id, label, count(*) area from lb group by all)
 select image_id, area, count(*) blobs from cs group by all""")
def _(v):
    blobs = shape.blob_geometry(stencil.find_blobs(green_mask(v)))
    return blobs.groupBy("image_id", "area").agg(F.count(F.lit(1)).alias("blobs"))


query("seg6_boundary", "pixels", """, mk as (select image_id, x, y from pixels where 2*g-r-b>0)
 select a.image_id, a.x, a.y from mk a join mk b on a.image_id=b.image_id and abs(a.x-b.x)<=1 and abs(a.y-b.y)<=1 group by all having count(*)<9""")(
    lambda v: stencil.boundary(green_mask(v)))

GL = f""", gr as (select image_id, x, y, {GREY_SQL} v from pixels),
 gm as (select a.image_id, ang angle, a.v i, b.v j, count(*) n from gr a cross join (values ('0',1,0),('45',1,1),('90',0,1),('135',-1,1),('180',-1,0)) o(ang,dx,dy)
 join gr b on a.image_id=b.image_id and b.x=a.x+dx and b.y=a.y+dy group by all)"""
query("tex1_glcm", "pixels", GL + " select * from gm")(lambda v: texture.glcm(grey(v)))
query("tex2_glcm_properties", "pixels", GL + f""", gp as (select *, n/cast(sum(n) over (partition by image_id, angle) as double) p from gm),
 gu as (select *, sum(i*p) over w mi, sum(j*p) over w mj from gp window w as (partition by image_id, angle)),
 ga as (select image_id, angle, sum(p*p) asm, sum(p*(i-j)*(i-j)) contrast, sum(p*abs(i-j)) dis, sum(p/(1+(i-j)*(i-j))) hom,
 sum(p*(i-mi)*(j-mj)) cov, sqrt(sum(p*(i-mi)*(i-mi))) si, sqrt(sum(p*(j-mj)*(j-mj))) sj from gu group by all)
 select image_id, {r6('avg(sqrt(asm))')} energy, {r6('avg(contrast)')} contrast, {r6('avg(dis)')} dissimilarity, {r6('avg(hom)')} homogeneity, {r6('avg(asm)')} "ASM",
 {r6('avg(case when si<1e-12 or sj<1e-12 then 1.0 else cov/(si*sj) end)')} correlation from ga group by image_id""")(
    lambda v: texture.glcm_properties(texture.glcm(grey(v))))
query("tex2_glcm_float_band", "pixels", """, q as (select image_id, x, y, r*0.21153661+g*(-0.52273617)+b*0.31119955 q from pixels),
 lv as (select image_id, x, y, cast(floor((q-min(q) over w)/(max(q) over w-min(q) over w)) as int) v from q window w as (partition by image_id))
 select a.image_id, ang angle, a.v i, b.v j, count(*) n from lv a cross join (values ('0',1,0),('45',1,1),('90',0,1),('135',-1,1),('180',-1,0)) o(ang,dx,dy)
 join lv b on a.image_id=b.image_id and b.x=a.x+dx and b.y=a.y+dy group by all""")(
    lambda v: texture.glcm(texture.to_levels(texture.band_levels(v.pixels, F.col("r") * 0.21153661 + F.col("g") * -0.52273617 + F.col("b") * 0.31119955), ["image_id"])))


def lbp_sql(points, radius):
    parts = [(k, dy, dx, w) for k, (sy, sx) in enumerate(texture.sample_points(points, radius)) for dy, dx, w in texture.bilinear_parts(sy, sx) if w]
    rows = ",".join(f"({k},{dy},{dx},{w!r}::double)" for k, dy, dx, w in parts)
    return f""", gr as (select image_id, x, y, {GREY_SQL} v from pixels), sp as (select * from (values {rows}) t(k,dy,dx,w)),
 sm as (select a.image_id, a.x, a.y, a.v, k, sum(w*coalesce(b.v,0)) s from gr a cross join sp left join gr b on b.image_id=a.image_id and b.x=a.x+dx and b.y=a.y+dy group by all),
 bi as (select image_id, x, y, k, cast(round(s,6)>=v as int) bit from sm),
 ch as (select *, cast(bit<>lag(bit) over (partition by image_id, x, y order by k) as int) c from bi),
 cd as (select image_id, x, y, case when coalesce(sum(c),0)<=2 then sum(bit) else {points + 1} end code from ch group by all),
 lh as (select i.image_id, c.code, count(cd.code)/(64+1e-7) share from (select distinct image_id from cd) i cross join range({points + 2}) c(code)
 left join cd on cd.image_id=i.image_id and cd.code=c.code group by all)"""


for points, radius in ((24, 8.0), (8, 1.0)):
    query(f"tex3_lbp_{points}", "pixels", lbp_sql(points, radius) + f" select image_id, code, {r6('share')} as \"share\" from lh")(
        lambda v, p=points, r=radius: texture.lbp_histogram(texture.lbp_codes(grey(v), points=p, radius=r), points=p)
        .select("image_id", F.posexplode("lbp").alias("code", "share")).withColumn("code", F.col("code").cast("long")))
query("tex4_lbp_stats", "pixels", lbp_sql(8, 1.0) + f" select image_id, {r6('stddev_pop(share)')} lbp_stddev, {r6('avg(share)')} lbp_mean, {r6('var_pop(share)')} lbp_variance from lh group by image_id")(
    lambda v: texture.array_stats(texture.lbp_histogram(texture.lbp_codes(grey(v), points=8, radius=1.0), points=8), "lbp", "lbp"))
HOG = """, hx as (select a.image_id, a.x, a.y, unnest(['r','g','b']) c, unnest([2,1,0]) pr,
 unnest([case when e.r is null or w.r is null then 0 else e.r-w.r end, case when e.r is null or w.r is null then 0 else e.g-w.g end, case when e.r is null or w.r is null then 0 else e.b-w.b end]) gx,
 unnest([case when s.r is null or n.r is null then 0 else s.r-n.r end, case when s.r is null or n.r is null then 0 else s.g-n.g end, case when s.r is null or n.r is null then 0 else s.b-n.b end]) gy
 from pixels a left join pixels e on e.image_id=a.image_id and e.y=a.y and e.x=a.x+1 left join pixels w on w.image_id=a.image_id and w.y=a.y and w.x=a.x-1
 left join pixels s on s.image_id=a.image_id and s.x=a.x and s.y=a.y+1 left join pixels n on n.image_id=a.image_id and n.x=a.x and n.y=a.y-1),
 hb as (select * from (select *, row_number() over (partition by image_id, x, y order by gx*gx+gy*gy desc, pr desc) k from hx) where k=1),
 hd as (select *, degrees(atan2(cast(gy as double),cast(gx as double))) a0 from hb),
 ha as (select *, case when a0<0 then a0+180 when a0>=180 then a0-180 else a0 end ang from hd),
 hc as (select image_id, y//4 as "row", x//4 as "col", cast(least(floor(round(ang,9)*9/180),8) as int) bin, sum(sqrt(cast(gx*gx+gy*gy as double)))/16 strength from ha group by all),
 h1 as (select *, least(strength/sqrt(sum(strength*strength) over (partition by image_id)+1e-10),0.2) a1 from hc),
 h2 as (select *, a1/sqrt(sum(a1*a1) over (partition by image_id)+1e-10) val from h1)"""
query("tex5_hog", "pixels", HOG + f""" select image_id, cast("row" as int) "row", cast("col" as int) "col", bin, {r6('val')} "value" from h2""")(
    lambda v: texture.hog_descriptor(texture.hog_cells(v.pixels, cell=4)).select("image_id", "row", "col", "bin", "value"))
query("tex6_hog_stats", "pixels", HOG + f""" select image_id, {r6('stddev_pop(val)')} hog_stddev, {r6('avg(val)')} hog_mean, {r6('var_pop(val)')} hog_variance from h2 where val<>0 group by image_id""")(
    lambda v: texture.hog_stats(texture.hog_descriptor(texture.hog_cells(v.pixels, cell=4))))
query("tex6_hog_stats_compat", "pixels", HOG + f""", h3 as (select image_id, (("row"*2+"col")*9+bin)*1.0 pos from h2 where val<>0)
 select image_id, {r6('stddev_pop(pos)')} hog_stddev, {r6('avg(pos)')} hog_mean, {r6('var_pop(pos)')} hog_variance from h3 group by image_id""")(
    lambda v: texture.hog_stats(texture.hog_descriptor(texture.hog_cells(v.pixels, cell=4)), compat=True))
