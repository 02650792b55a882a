"""Queries for splits, neighbours, imbalance correction, models, selection and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafspark.functions import rules
from leafspark.operators import discriminant, models, neighbors, resample, selection, shape, sweep
from leafspark.plans.registry import query, r6
from leafspark.session import dealt

DIMS = 64
NAMES = [f"e{i}" for i in range(DIMS)]
HASH = "(('0x'||substr(md5(concat({0},':',{1})),1,8))::bigint/4294967296.0)"
SPLIT = f", sp as (select *, {HASH.format('id', 42)}<0.4 is_train from vectors)"


def l2(a, b):
    return f"round(sqrt(list_sum(list_transform(list_zip({a},{b}), lambda z: (z[1]-z[2])*(z[1]-z[2])))),9)"


def l1(a, b):
    return f"round(list_sum(list_transform(list_zip({a},{b}), lambda z: abs(z[1]-z[2]))),9)"


query("ml1_split", "vectors", SPLIT + " select id, is_train from sp")(lambda v: resample.split(v.vectors).select("id", "is_train"))
query("ml1_split_stratified", "vectors", f""", k as (select *, row_number() over (partition by "type" order by {HASH.format('id', 42)}, id) r, count(*) over (partition by "type") n from vectors)
 select id, r<=round(n*0.4) is_train from k""")(
    lambda v: resample.split_stratified(v.vectors).select("id", "is_train"))
query("set6_complement", "vectors", SPLIT + """ select "type", count(*) filter (is_train) train, count(*) filter (not is_train) test from sp group by "type" """)(
    lambda v: complement(v.vectors))


def complement(df):
    train = resample.split(df).filter("is_train")
    test = df.join(train.select("id"), "id", "left_anti")
    return train.select("type", F.lit(1).alias("t")).unionByName(test.select("type", F.lit(0).alias("t"))).groupBy("type").agg(
        F.count_if(F.col("t") == 1).alias("train"), F.count_if(F.col("t") == 0).alias("test"))


query("ml2_scaler", "vectors", SPLIT + """, st as (select i, avg(features[i]) filter (is_train) m, stddev_pop(features[i]) filter (is_train) s from sp, range(1,65) t(i) group by i)
 select id, cast(i-1 as int) pos, """ + r6("(features[i]-m)/s") + ' as "value" from sp join st on true')(
    lambda v: scale(resample.split(v.vectors)).select("id", F.posexplode("features").alias("pos", "value")))


def scale(df):
    return models.scale_features(df.filter("is_train"), df, DIMS)


query("jn15_neighbors", "vectors", f""", d as (select a.id query_id, b.id, {l2('a.features', 'b.features')} dist from vectors a join vectors b on a.id<>b.id),
 k as (select *, row_number() over (partition by query_id order by dist, id)-1 place from d) select query_id, cast(place as int) place, {r6('dist')} dist, id from k where place<5""")(
    lambda v: neighbors.neighbor_rows(neighbors.nearest_neighbors(v.vectors, v.vectors, 5, 2, exclude_self=True)))
query("ml11_knn", "vectors", SPLIT + f""", d as (select a.id, b."type" t, {l1('a.features', 'b.features')} dist, row_number() over (partition by a.id order by {l1('a.features', 'b.features')}, b.id) k
 from sp a join sp b on not a.is_train and b.is_train),
 w as (select id, count(*) filter (dist=0) z, count(*) filter (dist=0 and t=1) z1, sum(1/dist) filter (dist>0) w, coalesce(sum(1/dist) filter (dist>0 and t=1),0) w1 from d where k<=5 group by id),
 pr as (select id, case when z>0 then z1/cast(z as double) else w1/w end p from w) select id, {r6('p')} probability, cast(round(p,9)>0.5 as int) prediction from pr""")(
    lambda v: knn(resample.split(v.vectors)))


def knn(df):
    return neighbors.classify(df.filter("not is_train"), df.filter("is_train"), 5, 1)


LDA = SPLIT + """, tr as (select features[1] a, features[2] b, "type" t from sp where is_train),
 cm as (select t, count(*) n, avg(a) ma, avg(b) mb from tr group by t),
 cv as (select sum((a-ma)*(a-ma))/(count(*)-2) saa, sum((b-mb)*(b-mb))/(count(*)-2) sbb, sum((a-ma)*(b-mb))/(count(*)-2) sab from tr join cm using (t)),
 so as (select (sbb*(m1.ma-m0.ma)-sab*(m1.mb-m0.mb))/(saa*sbb-sab*sab) wa, (saa*(m1.mb-m0.mb)-sab*(m1.ma-m0.ma))/(saa*sbb-sab*sab) wb,
 m1.ma a1, m1.mb b1, m0.ma a0, m0.mb b0, m1.n n1, m0.n n0 from cv, cm m1, cm m0 where m1.t=1 and m0.t=0),
 ld as (select id, 1/(1+exp(-(features[1]*wa+features[2]*wb-0.5*((a1+a0)*wa+(b1+b0)*wb)+ln(n1/cast(n0 as double))))) score from sp, so where not is_train)"""
query("ml10_lda", "vectors", LDA + f" select id, {r6('score')} score, cast(score>0.5 as int) prediction from ld")(lambda v: lda(resample.split(v.vectors)))


def lda(df):
    two = df.withColumn("features", F.slice("features", 1, 2))
    return discriminant.fit_score(two.filter("is_train"), two.filter("not is_train"), 2).select("id", "score", "prediction")


def lda_all(df):
    return discriminant.fit_score(df.filter("is_train"), df.filter("not is_train"), DIMS)


query("ml10_lda_all", "vectors")(lambda v: lda_all(resample.split(v.vectors)).select("id", "score", "prediction"))
query("ml18_create_imbalance", "vectors", f""", c as (select count(*) filter ("type"=0) crop, count(*) filter ("type"=1) weed from vectors)
 select id, "type" from vectors, c where "type"<>1 or {HASH.format('id', 42)}<=crop/(2/cast(1 as double))/weed""")(
    lambda v: resample.create_imbalance(v.vectors, 2, 1).select("id", "type"))
NN = f""", d as (select a.id query_id, b.id, a."type" ta, b."type" tb, row_number() over (partition by a.id order by {l2('a.features', 'b.features')}, b.id) k
 from vectors a join vectors b on a.id<>b.id)"""
query("ml24_tomek", "vectors", NN + """, n as (select query_id, id, ta, tb from d where k=1), l as (select a.query_id from n a join n b on a.id=b.query_id and b.id=a.query_id and a.ta<>a.tb where a.ta=1)
 select id, "type" from vectors where id not in (select query_id from l)""")(
    lambda v: resample.remove_tomek(v.vectors).select("id", "type"))
query("ml25_enn", "vectors", NN + """ select id, "type" from vectors where "type"=0 or id not in (select query_id from d where k<=3 and ta<>tb)""")(
    lambda v: resample.edited_neighbors(v.vectors).select("id", "type"))


def two_classes(v):
    return resample.split(v.vectors)


def counts_by_type(df):
    """Class sizes and a check that made rows lie inside the range of the given ones."""
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") < 0).alias("made"))


SHARE = HASH.format
FEW = f""", few as materialized (select * from vectors where "type"=0), sz as (select count(*) filter ("type"=0) n, count(*) filter ("type"=1) top from vectors),
 fk as (select a.id, b.id mate, row_number() over (partition by a.id order by {l2('a.features', 'b.features')}, b.id) k from few a join few b on a.id<>b.id),
 ak as (select a.id, b."type" t, row_number() over (partition by a.id order by {l2('a.features', 'b.features')}, b.id) k from few a join vectors b on a.id<>b.id)"""
EVEN = """, sd as (select *, row_number() over (order by id) r, count(*) over () c from seeds), wa as (select sd.id, features, (top-n)//c+case when r<=(top-n)%c then 1 else 0 end want from sd, sz)"""
MADE = f""", mk as (select wa.id, features, cast(j as bigint) j from wa join range(1,(select max(want)+1 from wa)) g(j) on j<=want),
 pk as (select *, floor({SHARE("concat(id,'-',j)", 2)}*5)+1 pick, {SHARE("concat(id,'-',j)", 3)} u from mk),
 nw as (select -('0x'||substr(md5(concat(pk.id,'-',j)),1,15))::bigint-1 id, 0 "type", pk.features[1]+(m.features[1]-pk.features[1])*u "first" from pk join fk on fk.id=pk.id and fk.k=pick join few m on m.id=fk.mate)
 select id, "type", {r6('"first"')} "first" from nw union all select id, "type", {r6('features[1]')} from vectors"""
SMOTE_SQL = {
    "SMOTE": FEW + ", seeds as (select * from few)" + EVEN + MADE,
    "ADASYN": FEW + """, oc as (select id, count(*) filter (t=1) o from ak where k<=5 group by id), wa as (select few.id, features,
 cast(round(o*(top-n)/cast(sum(o) over () as double)) as bigint) want from few join oc using (id), sz)""" + MADE,
    "BORDERLINE": FEW + """, oc as (select id, count(*) filter (t=1) o from ak where k<=10 group by id), seeds as (select few.* from few join oc using (id) where o>=5 and o<10)""" + EVEN + MADE}
for number, name in ((19, "SMOTE"), (20, "ADASYN"), (21, "BORDERLINE"), (22, "KMEANS"), (23, "SVM")):
    query(f"ml{number}_{name.lower()}", "vectors", SMOTE_SQL.get(name))(
        lambda v, name=name: resample.correct(v.vectors, name).select("id", "type", F.element_at("features", 1).alias("first")))
for name in ("SMOTETOMEK", "SMOTEENN"):
    query(f"ml26_{name.lower()}", "vectors")(lambda v, name=name: counts_by_type(resample.correct(v.vectors, name)))

OCC_SQL = SPLIT + f""", st as (select i, avg(features[i]) m, stddev_pop(features[i]) s from sp, range(1,{DIMS + 1}) t(i) where is_train and "type"=0 group by i),
 ds as (select id, is_train, "type", sqrt(sum(pow((features[i]-m)/s,2))) d from sp, st group by all), ct as (select quantile_disc(d,0.01) c from ds where is_train and "type"=0)
 select id, {r6('d/(d+1)')} score, cast(d>c as int) prediction from ds, ct where not is_train"""
for number, name in ((3, "LOGISTIC"), (4, "DECISIONTREE"), (5, "RANDOMFOREST"), (6, "GRADIENT"), (7, "EXTRA"), (8, "SVM"), (9, "MLP"), (12, "OCC")):
    query(f"ml{number}_{name.lower()}", "vectors", OCC_SQL if name == "OCC" else None)(
        lambda v, name=name: trained(two_classes(v), "OCC_DISTANCE" if name == "OCC" else name).select("id", "score", "prediction"))
query("ml12_one_class", "vectors")(lambda v: trained(two_classes(v), "OCC").select("id", "score", "prediction"))


def trained(df, name):
    """Rows that were not trained on, scored; every pass of the fit and the scoring read one table that is dealt over all cores."""
    df = dealt(df)
    return models.technique(name, DIMS).fit(df.filter("is_train"))(df.filter("not is_train"))


query("ml13_cross_validation", "vectors")(lambda v: models.cross_validate(v.vectors, models.technique("LDA", DIMS), 5))
query("ml14_assess", "vectors", LDA + f""", sc as (select ld.id, score, cast(score>0.5 as int) p, "type" a from ld join sp on ld.id=sp.id),
 cq as (select count(*) filter (p=1 and a=1) tp, count(*) filter (p=1 and a=0) fp, count(*) filter (p=0 and a=0) tn, count(*) filter (p=0 and a=1) fn from sc),
 fi as (select case when tp+fp=0 then 1 else 0 end z, (select arg_min(a,id) from sc) fa, * from cq),
 cn as (select tp+z*fa tp, fp+z*(1-fa) fp, tn-z*(1-fa) tn, fn-z*fa fn from fi),
 au as (select sum(case when x.score>y.score then 1.0 when x.score=y.score then 0.5 else 0.0 end)/count(*) auc from sc x, sc y where x.a=1 and y.a=0)
 select tp, fp, tn, fn, {r6('case when tp+fp=0 then 0.0 else tp/cast(tp+fp as double) end')} "precision", {r6('case when tp+fn=0 then 0.0 else tp/cast(tp+fn as double) end')} recall,
 {r6('case when tp=0 then 0.0 else 2*tp/cast(2*tp+fp+fn as double) end')} f1, {r6('(tp+tn)/cast(tp+fp+tn+fn as double)')} accuracy,
 {r6('(tp+tn)/cast(tp+fp+tn+fn as double)')} "map", {r6('auc')} auc from cn, au""")(
    lambda v: assessed(two_classes(v)))


def assessed(df):
    two = df.withColumn("features", F.slice("features", 1, 2))
    return models.assess(models.technique("LDA", 2).fit(two.filter("is_train"))(two.filter("not is_train")), compat=True)


query("ml14_assess_all", "vectors")(lambda v: models.assess(lda_all(two_classes(v)), compat=True))


@query("ml15_score_rows_all", "vectors")
def _(v):
    df = two_classes(v)
    edge = F.col("id") % 10 == 0
    rows = df.filter("not is_train").withColumn("reason", F.when(edge, rules.REASON_AT_EDGE).otherwise(0)).withColumn("type", F.when(edge, rules.UNKNOWN).otherwise(F.col("type")))
    return models.score_rows(models.technique("LDA", DIMS).fit(df.filter("is_train")), rows, reason=9).select("id", "type", "reason")


@query("ml15_score_rows", "vectors", LDA + """ select id, case when id%10=0 then 4 else cast(score>0.5 as int) end "type", case when id%10=0 then 1 else 9 end reason from ld""")
def _(v):
    df = two_classes(v)
    two = df.withColumn("features", F.slice("features", 1, 2))
    rows = two.filter("not is_train").withColumns({"reason": F.when(F.col("id") % 10 == 0, rules.REASON_AT_EDGE).otherwise(0)})
    rows = rows.withColumn("type", F.when(F.col("reason") == 1, rules.UNKNOWN).otherwise(F.col("type")))
    fitted = models.technique("LDA", 2).fit(two.filter("is_train"))
    return models.score_rows(fitted, rows, reason=9).select("id", "type", "reason")


query("ml16_pixel_classes", "pixels")(lambda v: pixel_classes(v.pixels))


def pixel_classes(pixels):
    train = pixels.filter("image_id % 5 = 0").select(F.col("image_id").alias("id"), F.array(*[F.col(c).cast("double") for c in "rgb"]).alias("features"),
                                                     (F.col("r") > F.col("g")).cast("int").alias("type"))
    fitted = models.technique("LDA", 3).fit(train)
    return models.classify_pixels(fitted, pixels, {c: F.col(c) for c in "rgb"})


ML27 = " " + " union all ".join(f"select 'e{i}' factor, features[{i + 1}] x, \"type\" t from vectors" for i in range(DIMS))
query("ml27_univariate", "vectors", f""", lx as ({ML27}), cx as (select factor, t, count(*) n, avg(x) m, sum(x) s, var_pop(x)*count(*) w from lx group by all),
 fx as (select factor, sum(n) n, sum(s)/sum(n) gm, sum(w) w from cx group by factor)
 select cx.factor, {r6('sum(cx.n*(m-gm)*(m-gm))/(any_value(fx.w)/(any_value(fx.n)-2))')} score from cx join fx on cx.factor=fx.factor group by cx.factor""")(
    lambda v: selection.univariate(v.vectors, NAMES))
query("ml28_pca", "vectors")(lambda v: selection.pca(v.vectors, NAMES))
query("ml29_importance", "vectors")(lambda v: selection.importance(v.vectors, NAMES, trees=10))
query("ml30_recursive", "vectors")(lambda v: selection.recursive(v.vectors, NAMES))
query("ml31_variance", "vectors", f""", lx as ({ML27}) select factor, {r6('var_pop(x)')} score from lx group by factor""")(
    lambda v: selection.variance(v.vectors, NAMES))
query("ml32_all_selectors", "vectors")(lambda v: selection.all_selectors(v.vectors, NAMES))
query("ml17_registry", "vectors")(lambda v: models.assess(trained(two_classes(v), "DECISIONTREE")).withColumn("technique", F.lit("DECISIONTREE")))


@query("ml33_sweep", "vectors")
def _(v):
    df = two_classes(v)
    return sweep.discriminant_sweep(df.filter("is_train"), df.filter("not is_train"), NAMES, 3)


query("ml33_sweep_techniques", "vectors")(lambda v: sweep.sweep(
    two_classes(v), [(0, 1, 2), (3, 4, 5)], NAMES, ["LDA", "DECISIONTREE"], ["NONE", "SMOTE"]))
PAIRS = SPLIT + """, tl as (select id, is_train, "type" t, i-1 i, features[i] v from sp, range(1,65) r(i)), cm as (select t, i, count(*) n, avg(v) m from tl where is_train group by all),
 ce as (select tl.id, tl.t, tl.i, v-m d from tl join cm on tl.t=cm.t and tl.i=cm.i where is_train),
 cv as (select a.i i, b.i j, sum(a.d*b.d)/(count(*)-2) s from ce a join ce b on a.id=b.id and a.i<=b.i group by all),
 m1 as (select i, m, n from cm where t=1), m0 as (select i, m, n from cm where t=0),
 so as (select c.i, c.j, (sj.s*(a1.m-a0.m)-c.s*(b1.m-b0.m))/(si.s*sj.s-c.s*c.s) wa, (si.s*(b1.m-b0.m)-c.s*(a1.m-a0.m))/(si.s*sj.s-c.s*c.s) wb, a1.m+a0.m am, b1.m+b0.m bm, ln(a1.n/cast(a0.n as double)) pr
 from cv c join cv si on si.i=c.i and si.j=c.i join cv sj on sj.i=c.j and sj.j=c.j join m1 a1 on a1.i=c.i join m0 a0 on a0.i=c.i join m1 b1 on b1.i=c.j join m0 b0 on b0.i=c.j where c.i<c.j),
 pd as (select so.i, so.j, cast(a.v*wa+b.v*wb-0.5*(am*wa+bm*wb)+pr>=0 as int) p, a.t from so join tl a on a.i=so.i and not a.is_train join tl b on b.i=so.j and b.id=a.id),
 cf as (select i, j, count(*) filter (p=1 and t=1) tp, count(*) filter (p=1 and t=0) fp, count(*) filter (p=0 and t=0) tn, count(*) filter (p=0 and t=1) fn from pd group by all)"""
query("ml33_sweep_pairs", "vectors", PAIRS + f""" select 'e'||i||'+e'||j parameters, {r6('(tp+tn)/cast(tp+fp+tn+fn as double)')} accuracy, {r6('case when tp+fp=0 then 0.0 else tp/cast(tp+fp as double) end')} "precision",
 {r6('case when tp+fn=0 then 0.0 else tp/cast(tp+fn as double) end')} recall from cf""")(
    lambda v: sweep.technique_sweep(two_classes(v), NAMES, 2, ["LDA"], ["NONE"]).select(F.array_join("parameters", "+").alias("parameters"), "accuracy", "precision", "recall"))
query("ml33_sweep_all_pairs", "vectors")(lambda v: sweep.technique_sweep(two_classes(v), NAMES, 2))
query("ml34_imbalance_grid", "vectors")(lambda v: sweep.imbalance_grid(two_classes(v), DIMS, [(2, 1), (4, 1)], ["NONE", "SMOTE"], ["LDA"]))


@query("ml35_rerun_best", "vectors")
def _(v):
    df = two_classes(v)
    results = sweep.discriminant_sweep(df.filter("is_train"), df.filter("not is_train"), NAMES, 2)
    others = sweep.sweep(df, [(0, 1), (2, 3)], NAMES, ["DECISIONTREE", "LOGISTIC"], ["NONE", "SMOTE"]).withColumn("id", F.col("id") + 1000)
    return sweep.rerun_best(df, results.unionByName(others), NAMES)


# Pluggable parts.
query("udf1_blob_reducer", "pixels", f" select image_id, {r6('stddev_pop(nullif(g,0))')} reduced from pixels group by image_id")(
    lambda v: shape.reduce_blobs(v.pixels, ["image_id"], "g", lambda a: [(a != 0).sum(), a.sum(), (a.astype(float) ** 2).sum()],
                                 lambda p: F.sqrt(p[2] / p[0] - p[1] / p[0] * (p[1] / p[0]))))
query("udf3_selector", "vectors", f""", lx as ({ML27}) select factor, {r6('max(x)-min(x)')} score from lx group by factor""")(
    lambda v: selection.run_selector(selection.ColumnSelector("Range", lambda c: F.max(c) - F.min(c)), v.vectors, NAMES))


class Majority:
    """A custom technique: always the commoner class."""

    def fit(self, train):
        common = train.agg(F.mode("type").alias("m")).scalar()
        return lambda rows: rows.withColumn("prediction", common).withColumn("score", F.col("prediction").cast("double"))


query("udf4_technique", "vectors", SPLIT + """ select id, (select case when count(*) filter ("type"=1)>count(*) filter ("type"=0) then 1 else 0 end from sp where is_train) prediction from sp where not is_train""")(
    lambda v: Majority().fit(two_classes(v).filter("is_train"))(two_classes(v).filter("not is_train")).select("id", "prediction"))
