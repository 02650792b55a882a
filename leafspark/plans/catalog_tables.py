"""Queries over factor, prediction, result and season tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafspark.functions import catalog_of_factors, metrics, rules, scalars
from leafspark.operators import evaluation, profile, ranking, timeseries
from leafspark.operators.grouped import ordered_scan
from leafspark.plans.registry import query, r6
from leafspark.session import cut_lineage

FACTORS = ["hue", "saturation_mean", "in_phase", "shape_index", "compactness"]
SCORES = ranking.SCORES


def quoted(names):
    return ", ".join(f'"{n}"' for n in names)


def catalog_frame(spark):
    return spark.createDataFrame(catalog_of_factors.factor_rows(), "type string, subtype string, factor string, kind string, space string")


CAT = ", fc as (select * from (values " + ", ".join(f"('{a}','{b}','{c}','{d}','{e}')" for a, b, c, d, e in catalog_of_factors.factor_rows()) + ") t(\"type\",subtype,factor,kind,space))"
LONG = ", lf as (" + " union all ".join(f"select \"type\", '{f}' factor, cast({f} as double) val from factors" for f in FACTORS) + ")"

# Factor tables.
query("src1_factor_scan", "factors", ' select "type", hue, ' + r6("shape_index") + ' shape_index from factors')(
    lambda v: v.factors.select("type", "hue", "shape_index"))
query("flt4_clean", "factors", f" select name, number, hue, saturation_mean, in_phase, {r6('shape_index')} shape_index, compactness from factors where hue<>0 and saturation_mean<>0 and in_phase<>0 and shape_index<>0 and compactness<>0")(
    lambda v: profile.clean_factors(v.factors, FACTORS).select("name", "number", *FACTORS))
query("flt4_dropped", "factors", ", z as (select hue=0 or saturation_mean=0 or in_phase=0 or shape_index=0 or compactness=0 bad from factors) select count(*) filter (not bad) kept, count(*) filter (bad) dropped from z")(
    lambda v: profile.dropped_rows(v.factors, FACTORS))


@query("flt9_factor_selection", "results", CAT + """, u as (select unnest(parameters) factor from results)
 select fc.factor, "type", space, count(*) used from fc join u on fc.factor=u.factor where "type" in ('COLOR','TEXTURE') and kind='SCALAR'
 and fc.factor<>'hog_mean' and (("type"='TEXTURE')=(space='GREYSCALE')) group by all""")
def _(v):
    names = catalog_of_factors.select_factors(types=("COLOR", "TEXTURE"), blacklist=("hog_mean",), restricted=[("TEXTURE", "GREYSCALE")])
    used = v.results.select(F.explode("parameters").alias("factor")).filter(F.col("factor").isin(*names))
    return used.groupBy("factor").agg(F.count(F.lit(1)).alias("used")).join(
        F.broadcast(catalog_frame(v.spark)), "factor").select("factor", "type", "space", "used")


query("flt10_composed_of", "results", CAT + """ select id, technique from results where
 list_has_all((select list(factor) from fc where "type" in ('SHAPE','COLOR') and kind='SCALAR'), parameters)""")(
    lambda v: ranking.composed_of(v.results, catalog_frame(v.spark), ["SHAPE", "COLOR"]).select("id", "technique"))
query("flt11_completed", "results", " select id, technique from results where status=2 and technique<>'OCC'")(
    lambda v: ranking.completed(v.results).select("id", "technique"))
query("flt19_name_parse", "factors", """ select name, cast(regexp_extract(name,'image-(\\d+)-blob',1) as bigint) image,
 cast(regexp_extract(name,'-blob-?(\\d+)$',1) as bigint) blob from factors where contains(name,'image-1')""")(
    lambda v: v.factors.filter(F.col("name").contains("image-1")).select(
        "name", *[c.alias(n) for n, c in rules.parse_name(F.col("name")).items()]))
query("agg7_class_ratio", "factors", """, c as (select count(*) filter ("type"=0) crop, count(*) filter ("type"=1) weed from factors)
 select crop, weed, crop||':'||weed||' CROP:WEED ('||printf('%.4f', crop/cast(weed as double))||')' ratio from c""")(
    lambda v: profile.class_ratio(v.factors))
query("agg8_tidy_profile", "factors", LONG + f""" select factor, cast(count(*) filter (val=0) as bigint) zeros, {r6('count(distinct val)/cast(count(*) as double)')} uniqueness,
 count(distinct val)/cast(count(*) as double)<0.9 as "drop" from lf group by factor""")(
    lambda v: profile.tidy_profile(v.factors, FACTORS))
query("agg9_zero_listing", "factors", LONG + ' select "type", factor, count(*) filter (val=0) zeros, count(*) as "rows" from lf group by all')(
    lambda v: profile.zero_listing(v.factors, FACTORS))
query("agg10_mean_time", "perf_log", f' select activity, {r6("avg(us)")} as "microseconds" from perf_log group by activity')(
    lambda v: v.perf_log.groupBy("activity").agg(F.avg("microseconds").alias("microseconds")))
query("agg26_normalise", "factors", " select name, number, " + ", ".join(
    r6(f"case when max({f}) over ()=min({f}) over () then 1.0 else ({f}-min({f}) over ())/(max({f}) over ()-min({f}) over ()) end") + f" {f}" for f in FACTORS) + " from factors")(
    lambda v: profile.normalise_factors(v.factors, FACTORS).select("name", "number", *FACTORS))


@query("agg27_variance_by_selector", "factors", LONG + f""", va as (select factor, var_samp(val) variance from lf group by factor)
 select factor, {r6('variance', 4)} variance, case when row_number() over (order by factor)<=3 then 'PCA' else 'Univariate' end selector from va""", places=4)
def _(v):
    names = v.spark.createDataFrame([(i, "PCA" if i < 3 else "Univariate") for i in range(5)], "i int, selector string")
    return profile.attach_by_position(profile.factor_variance(v.factors, FACTORS), "factor", names, "i").select("factor", "variance", "selector")


PAIRS = [(a, b) for i, a in enumerate(FACTORS) for b in FACTORS[i + 1:]]
query("agg28_correlation", "factors", " " + " union all ".join(
    f"select \"type\", '{a}|{b}' pair, {r6(f'corr({a},{b})')} correlation from factors group by \"type\"" for a, b in PAIRS))(
    lambda v: profile.factor_correlation(v.factors, FACTORS))
query("agg29_quartiles", "factors", LONG + " " + " union all ".join(
    f"select \"type\", factor, {p} p, {r6(f'quantile_cont(val,{p})', 8)} quantile from lf group by \"type\", factor" for p in (0.25, 0.5, 0.75)), 8)(
    lambda v: profile.exact_quantiles(profile.long_form(v.factors, ["type"], FACTORS), ["type", "factor"], [0.25, 0.5, 0.75]))
query("set2_distinct_factors", "results", " select distinct unnest(parameters) factor from results where status=2")(
    lambda v: ranking.completed(v.results, ranking.BINARY + ranking.ONE_CLASS).select(F.explode("parameters").alias("factor")).distinct())
query("jn9_positional", "factors", LONG + f""", va as (select factor, row_number() over (order by factor) place, avg(val) m from lf group by factor),
 vb as (select "type", row_number() over (order by "type") place from factors group by "type") select place, factor, {r6('m')} mean, "type" from va join vb using (place)""")(
    lambda v: profile.attach_by_position(
        profile.long_form(v.factors, [], FACTORS).groupBy("factor").agg(F.avg("value").alias("mean")), "factor",
        v.factors.select("type").distinct(), "type").select(F.col("place").cast("long").alias("place"), "factor", "mean", "type"))

# Predictions.
CM = """, cm as (select technique, count(*) filter ("type"=1 and actual=1) tp, count(*) filter ("type"=1 and actual=0) fp,
 count(*) filter ("type"=0 and actual=0) tn, count(*) filter ("type"=0 and actual=1) fn from predictions group by technique)"""


def div(a, b):
    return f"(case when {b}=0 then 0.0 else ({a})/cast({b} as double) end)"


TPR, FPR, FNR, TNR = div("tp", "(tp+fn)"), div("fp", "(fp+tn)"), div("fn", "(tp+fn)"), div("tn", "(tn+fp)")
PPV, NPV, FDR, FOMR = div("tp", "(tp+fp)"), div("tn", "(tn+fn)"), div("fp", "(tp+fp)"), div("fn", "(tn+fn)")
METRIC_SQL = {
    "agg2_rates": (metrics.rates, {"fpr": FPR, "fnr": FNR, "tpr": TPR, "tnr": TNR}),
    "agg3_scores": (metrics.scores, {"precision": PPV, "recall": TPR, "f1": f"{div(f'{PPV}*{TPR}', f'({PPV}+{TPR})')}*2",
                                     "accuracy": div("tp+tn", "(tp+fp+fn+tn)")}),
    "agg4_predictive": (metrics.predictive, {"pp": "tp+fp", "pn": "tn+fn", "ppv": PPV, "npv": NPV, "fdr": FDR, "fomr": FOMR}),
    "agg5_agreement": (metrics.agreement, {
        "mcc": f"sqrt({TPR}*{TNR}*{PPV}*{NPV})-sqrt({FNR}*{FPR}*{FOMR}*{FDR})", "fm": f"sqrt({PPV}*{TPR})",
        "prevalence": div("tp+fn", "(tp+fp+fn+tn)"), "lr_plus": div(TPR, FPR), "lr_minus": div(FNR, TNR), "population": "tp+fp+tn+fn"}),
    "agg6_field_rates": (metrics.field_rates, {"miss_rate": f"{FPR}*100", "hit_rate": f"{TPR}*100"})}
query("agg1_confusion", "predictions", CM + " select * from cm")(lambda v: evaluation.confusion_table(v.predictions, ["technique"]))
query("agg1_confusion_labels", "", 'select count(*) filter (quality=1 and toxic=1) tp, count(*) filter (quality=1 and toxic=0) fp, count(*) filter (quality=0 and toxic=0) tn, count(*) filter (quality=0 and toxic=1) fn from labels')(
    lambda v: evaluation.confusion_table(v.table("labels"), [], "quality", "toxic"))
for name, (family, texts) in METRIC_SQL.items():
    whole = {"pp", "pn", "population"}
    columns = ", ".join(f'{t if c in whole else r6(t)} "{c}"' for c, t in texts.items())
    query(name, "predictions", f"{CM} select technique, {columns} from cm")(
        lambda v, family=family, texts=texts: evaluation.with_metrics(
            evaluation.confusion_table(v.predictions, ["technique"]), family).select("technique", *texts))


@query("agg11_mask_means", "pixels", f""", k as (select image_id, image_id%3 technique, cast(2*g-r-b>50 as int) m, cast(g>r as int) f from pixels),
 c as (select image_id, technique, count(*) filter (m=1 and f=1) tp, count(*) filter (m=1 and f=0) fp, count(*) filter (m=0 and f=0) tn,
 count(*) filter (m=0 and f=1) fn from k group by all), q as (select technique, avg({FPR}) "FPR", avg({FNR}) "FNR", avg({FPR}+{FNR}) "Total" from c group by technique)
 select technique, 'FPR' as name, {r6('"FPR"')} as "value", {r6('"Total"')} as "Total" from q union all select technique, 'FNR', {r6('"FNR"')}, {r6('"Total"')} from q""")
def _(v):
    per_image = evaluation.with_metrics(masks(v), metrics.rates).withColumns(
        {"technique": F.col("image_id") % 3, "Total": F.col("fpr") + F.col("fnr")})
    means = per_image.groupBy("technique").agg(F.avg("fpr").alias("FPR"), F.avg("fnr").alias("FNR"), F.avg("Total").alias("Total"))
    return means.unpivot(["technique", "Total"], ["FPR", "FNR"], "name", "value")


def masks(v):
    p = v.pixels
    mask = p.select("image_id", "x", "y", rules.threshold_mask(p.g * 2 - p.r - p.b, 50).alias("v"))
    reference = p.select("image_id", "x", "y", (p.g > p.r).cast("int").alias("v"))
    return evaluation.compare_masks(mask, reference)


query("jn5_mask_compare", "pixels", """, k as (select image_id, cast(2*g-r-b>50 as int) m, cast(g>r as int) f from pixels)
 select image_id, count(*) filter (m=1 and f=1) tp, count(*) filter (m=1 and f=0) fp, count(*) filter (m=0 and f=0) tn,
 count(*) filter (m=0 and f=1) fn from k group by image_id""")(masks)
query("jn8_correction_delta", "results", f""", p as (select technique, id%100 ratio, max(auc) a, max(f1) f from results where correction='NONE' group by all)
 select r.technique, r.id%100 ratio, correction, {r6('auc-a')} auc_delta, {r6('f1-f')} f1_delta from results r join p on r.technique=p.technique and r.id%100=p.ratio where correction<>'NONE'""")(
    lambda v: evaluation.correction_delta(v.results.withColumn("ratio", F.col("id") % 100), ["technique", "ratio"], ["auc", "f1"]))
ROC = """, st as (select technique, score, count(*) filter (actual=1) p, count(*) filter (actual<>1) n from predictions group by all),
 rc as (select technique, score threshold, sum(n) over w/cast(sum(n) over (partition by technique) as double) fpr,
 sum(p) over w/cast(sum(p) over (partition by technique) as double) tpr from st window w as (partition by technique order by score desc))"""
query("win7_roc", "predictions", ROC + f" select technique, {r6('threshold')} threshold, {r6('fpr')} fpr, {r6('tpr')} tpr from rc")(
    lambda v: evaluation.roc_points(v.predictions, ["technique"]))
query("win8_auc", "predictions", ROC + f""", ar as (select technique, (fpr-coalesce(lag(fpr) over w,0.0))*(tpr+coalesce(lag(tpr) over w,0.0))/2 a
 from rc window w as (partition by technique order by threshold desc)) select technique, {r6('sum(a)')} auc from ar group by technique""")(
    lambda v: evaluation.auc(v.predictions, ["technique"]))
query("win9_ideal_threshold", "predictions", ROC + f""", k as (select *, row_number() over (partition by technique order by round(abs(tpr-(1-fpr)),9), threshold desc) n from rc)
 select technique, {r6('threshold')} threshold, {r6('fpr')} fpr, {r6('tpr')} tpr from k where n=1""")(
    lambda v: evaluation.ideal_threshold(evaluation.roc_points(v.predictions, ["technique"]), ["technique"]))


@query("win10_mean_roc", "predictions", ROC.replace("technique", "technique, fold").replace("from predictions", "from (select *, image_id%5 fold from predictions)") + f""",
 co as (select technique, fold, fpr, max(tpr) hi, min(tpr) lo from (select technique, fold, fpr, tpr from rc union all select distinct technique, fold, 0.0, 0.0 from rc) group by all),
 sg as (select *, lag(fpr) over w f0, lag(hi) over w t0 from co window w as (partition by technique, fold order by fpr)),
 gr as (select technique, fold, i, case when i=0 then 0.0 when abs(i/99.0-fpr)<1e-9 then hi else t0+(lo-t0)*(i/99.0-f0)/(fpr-f0) end val
 from sg join range(100) g(i) on i<=floor(fpr*99+1e-9) and i>=(case when f0 is null then 0 else floor(f0*99+1e-9)+1 end))
 select technique, cast(i as int) place, {r6('case when i=99 then 1.0 else avg(val) end')} tpr_mean, {r6('stddev_pop(val)')} tpr_std from gr group by technique, i""")
def _(v):
    folded = v.predictions.withColumn("fold", F.col("image_id") % 5)
    return evaluation.mean_roc(evaluation.roc_points(folded, ["technique", "fold"]), ["technique"], "fold")


# Results.
DONE = ", d as (select * from results where status=2 and technique<>'OCC')"
query("agg13_best_rows", "results", DONE + f""", k as (select *, row_number() over (partition by technique order by auc desc, id) n from d)
 select id, technique, correction, {r6('auc')} auc, {r6('f1')} f1 from k where n=1""")(
    lambda v: ranking.best_rows(ranking.completed(v.results), "auc").select("id", "technique", "correction", "auc", "f1"))
query("agg14_highest", "results", DONE + " select technique, " + ", ".join(f'{r6(f"max({chr(34)}{s}{chr(34)})")} "{s}"' for s in SCORES) + " from d group by technique")(
    lambda v: ranking.highest_scores(ranking.completed(v.results)))
query("agg15_close", "results", DONE + ", w as (select *, " + ", ".join(f'max("{s}") over (partition by technique) m_{s}' for s in SCORES) + " from d) select technique, "
      + ", ".join(r6(f'count(*) filter (abs("{s}"-m_{s})<=greatest(abs("{s}"),abs(m_{s}))*0.1)*100/cast(count(*) as double)') + f' "{s}"' for s in SCORES) + " from w group by technique")(
    lambda v: ranking.close_to_highest(ranking.completed(v.results), 0.1))
query("agg16_parameter_counts", "results", DONE + """, k as (select *, row_number() over (partition by technique order by auc desc, id) n from d),
 u as (select unnest(parameters) parameter from k where n=1) select parameter, count(*) n from u group by parameter""")(
    lambda v: ranking.parameter_counts(ranking.best_rows(ranking.completed(v.results), "auc")))
query("agg17_summary", "results", DONE + ", b as (" + " union ".join(
    f'(select technique, id, {quoted(ranking.SUMMARY_SCORES)} from (select *, row_number() over (partition by technique order by "{s}" desc, id) n from d) where n=1)' for s in ranking.SUMMARY_SCORES)
      + ") select technique, count(*) models, " + ", ".join(f'{r6(f"avg({chr(34)}{s}{chr(34)})")} "{s}"' for s in ranking.SUMMARY_SCORES) + " from b group by technique")(
    lambda v: ranking.summary(ranking.completed(v.results)))
query("agg18_running_max", "results", DONE + " " + " union all ".join(
    f"select technique, '{s}' criterion, {r6(chr(34) + s + chr(34))} result, id, array_to_string(parameters,',') parameters, correction from (select *, row_number() over (partition by technique order by \"{s}\" desc, id) n from d) where n=1" for s in SCORES))(
    lambda v: ranking.running_maximum(ranking.completed(v.results)).withColumn("parameters", F.concat_ws(",", "parameters")))
query("top1_top_n", "results", DONE + f""", k as (select id, technique, auc, dense_rank() over (order by auc desc) place from d)
 select place, id, technique, {r6('auc')} auc, id=min(id) over (partition by place) winner from k where place<=5""")(
    lambda v: ranking.top_with_equals(ranking.completed(v.results), "auc", 5))
query("top2_top_factors", "results", """, u as (select technique selector, unnest(parameters) factor from results where status=2),
 c as (select selector, factor, count(*) score from u group by all), k as (select *, row_number() over (partition by selector order by score desc, factor) place from c)
 select selector, factor, score, place from k where place<=4""")(
    lambda v: ranking.top_factors(v.results.filter("status = 2").select(F.col("technique").alias("selector"), F.explode("parameters").alias("factor"))
                                  .groupBy("selector", "factor").agg(F.count(F.lit(1)).alias("score")), "selector", "score", 4))
query("top3_order_by_auc", "results", DONE + f" select technique, {r6('max(auc)')} auc from d group by technique order by auc desc, technique")(
    lambda v: ranking.highest_scores(ranking.completed(v.results)).select("technique", "auc").orderBy(F.desc("auc"), "technique"))
query("win4_rank", "results", DONE + """ select id, technique, rank() over (partition by technique order by auc desc) "rank" from d""")(
    lambda v: technique_rank(v.results))


def technique_rank(results):
    """Rank per technique: count better distinct scores first, so no technique is sorted row by row in one task."""
    d = ranking.completed(results)
    levels = cut_lineage(d.groupBy("technique", "auc").agg(F.count(F.lit(1)).alias("n")))
    ranks = ordered_scan(levels, ["technique"], [-F.col("auc")], -F.floor(F.col("auc") * 64), sums={"upto": F.col("n")})
    return d.join(ranks.select("technique", "auc", (F.col("upto") - F.col("n") + 1).alias("rank")), ["technique", "auc"]).select("id", "technique", "rank")


query("set3_drop_duplicates", "results", f" select distinct technique, correction, {r6('f1')} f1 from results")(
    lambda v: v.results.select("technique", "correction", "f1").dropDuplicates())
query("set4_combinations", "results", """, u as (select distinct unnest(parameters) f from results), n as (select f, row_number() over (order by f) i from u)
 select a.i||'-'||b.i||'-'||c.i combo_id, a.f||','||b.f||','||c.f factors from n a join n b on a.i<b.i join n c on b.i<c.i""")(
    lambda v: ranking.combinations_of(v.results.select(F.explode("parameters").alias("factor")).distinct(), 3).withColumn("factors", F.concat_ws(",", "factors")))
query("set5_batches", "results", " select id, id//50 batch from results")(
    lambda v: ranking.batched(v.results.select("id"), "id", 50))
CNT = "cast(len(list_filter({bag}, lambda t: t={term})) as double)"
SIM = """, sel as (select ['hue','shape_index','compactness'] as s), sm as (select technique, accuracy, parameters, status, id,
 (select sum(len(list_filter(parameters, lambda t: t=q))*1.0) from (select unnest(['hue','shape_index','compactness']) q))
 /(sqrt((select sum(pow(len(list_filter(parameters, lambda t: t=q)),2)) from (select unnest(list_distinct(parameters)) q)))*sqrt(3.0)) sim from results)"""
query("scl7_similarity", "results", SIM + f" select id, {r6('sim')} similarity from sm")(
    lambda v: v.results.select("id", scalars.bag_cosine(F.col("parameters"), F.array(F.lit("hue"), F.lit("shape_index"), F.lit("compactness"))).alias("similarity")))
query("scl8_similarity_search", "results", SIM + f" select distinct technique, {r6('accuracy')} accuracy, {r6('sim')} \"Univariate\" from sm where status=2 and sim>=0.5")(
    lambda v: ranking.similar_to(v.results, {"Univariate": ["hue", "shape_index", "compactness"]}, 0.5))
query("scl9_run_name", "results", " select id, technique||'_'||correction run, 'Results for '||technique caption from results")(
    lambda v: v.results.select("id", scalars.run_name(F.col("technique"), F.col("correction")).alias("run"),
                               scalars.caption("Results for %T", F.col("technique")).alias("caption")))
query("src16_results_by_name", "results", " select technique, correction, count(*) n from results group by all")(
    lambda v: v.results.withColumn("run", scalars.run_name(F.col("technique"), F.col("correction")))
    .select(F.split("run", "_")[0].alias("technique"), F.split("run", "_")[1].alias("correction"))
    .groupBy("technique", "correction").agg(F.count(F.lit(1)).alias("n")))

# Seasons.
query("agg12_season_means", "season", f' select "type", cast("date" as varchar) "date", {r6("avg(hue)", 4)} hue, {r6("avg(saturation_mean)", 4)} saturation_mean from season group by all', places=4)(
    lambda v: timeseries.season_means(v.season, ["hue", "saturation_mean"]).withColumn("date", F.col("date").cast("string")))
MONTHS = ["1996-01-01", "1997-06-01", "1998-12-01"]
query("agg12_unstack", "season", ' select "type", ' + ", ".join(
    f"{r6(f'avg(hue) filter ({chr(34)}date{chr(34)}=date {chr(39)}{m}{chr(39)})', 4)} \"{m}\"" for m in MONTHS) + ' from season group by "type"', places=4)(
    lambda v: timeseries.unstack(timeseries.season_means(v.season, ["hue"]).withColumn("date", F.col("date").cast("string")), "hue", MONTHS))


@query("agg12_unstack_all", "season")
def _(v):
    """Every date of the season table, found first: a column a day, a few hundred a year."""
    means = timeseries.season_means(v.season, ["hue"]).withColumn("date", F.col("date").cast("string"))
    return timeseries.unstack(means, "hue", [r["date"] for r in means.select("date").where("date is not null").distinct().orderBy("date").collect()])


DF = ", sm as (" + " union all ".join(f"select \"type\", \"date\", '{f}' factor, avg({f}) val from season group by \"type\", \"date\"" for f in ["hue", "saturation_mean"]) + """),
 sl as (select *, lag(val) over (partition by "type", factor order by "date") lv from sm), sd as (select *, val-lv ch from sl where lv is not null),
 ft as (select "type", factor, count(*) n, regr_sxx(ch,lv) sxx, regr_sxy(ch,lv) sxy, regr_syy(ch,lv) syy from sd group by all),
 te as (select "type", factor, n, (sxy/sxx)/sqrt((syy-sxy/sxx*sxy)/(n-2)/sxx) t, -2.86154+(-2.8903)/n+(-4.234)/(n*n) lim from ft)"""
query("win5_stationarity", "season", DF + f' select "type", factor, n, {r6("t")} t, {r6("lim")} "limit" from te')(
    lambda v: timeseries.stationarity(v.season, ["hue", "saturation_mean"]))
query("win5_stable_factors", "season", DF + " select factor, bool_and(t<lim) stable from te group by factor")(
    lambda v: timeseries.stable_factors(timeseries.stationarity(v.season, ["hue", "saturation_mean"])))

# Bands at scale.
query("agg22_nonzero", "pixels_long", " select image_id, count(*) filter (g<>0) nonzero, count(*) filter (b>0) positive, count(*) n from pixels_long group by image_id")(
    lambda v: v.pixels_long.groupBy("image_id").agg(F.count_if(F.col("g") != 0).alias("nonzero"), F.count_if(F.col("b") > 0).alias("positive"), F.count(F.lit(1)).alias("n")))
query("agg23_histogram", "pixels_long", " select x, cast(least(floor((g-0.0)*16/256.0),15) as int) bin, count(*) n from pixels_long group by all")(
    lambda v: profile.value_histogram(v.pixels_long, ["x"], "g", 0.0, 256.0, 16))
query("agg24_majority", "pixels_long", ", c as (select x, g, count(*) n from pixels_long group by all), k as (select *, row_number() over (partition by x order by n desc, g) r from c) select x, g majority, n from k where r=1")(
    lambda v: profile.majority(v.pixels_long, ["x"], "g"))
query("agg25_band_mean", "pixels_long", f" select image_id, {r6('coalesce(avg(g) filter (g between 100 and 120), -15000.0)')} mean from pixels_long group by image_id")(
    lambda v: profile.band_mean_in_range(v.pixels_long, ["image_id"], "g", 100, 120))
