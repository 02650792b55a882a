"""Derived views: imagery-shaped tables read from the given parquet files.

Each view has a Spark builder (an attribute of :class:`Views`) and a text in :data:`VIEW_SQL`
that another SQL engine can run on the same files.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Techniques, corrections, and 24 directions (1000 * cos and sin of 15-degree steps).
TECHNIQUES = ["RANDOMFOREST", "KNN", "GRADIENT", "LDA", "SVM", "LOGISTIC", "MLP", "DECISIONTREE", "EXTRA", "OCC"]
CORRECTIONS = ["NONE", "SMOTE", "ADASYN", "BORDERLINE"]
PARAMETERS = ["hue", "saturation_mean", "in_phase", "cb_mean", "shape_index", "compactness", "convexity", "elongation",
              "eccentricity", "roundness", "solidity", "bending", "normalized_distance", "hog_mean", "greyscale_lbp_mean",
              "greyscale_energy_avg"]
COS24 = [1000, 966, 866, 707, 500, 259, 0, -259, -500, -707, -866, -966,
         -1000, -966, -866, -707, -500, -259, 0, 259, 500, 707, 866, 966]
SIN24 = [0, 259, 500, 707, 866, 966, 1000, 966, 866, 707, 500, 259,
         0, -259, -500, -707, -866, -966, -1000, -966, -866, -707, -500, -259]

CONTOURS_OF_TASK = 250_000


def _list_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def _strings(values):
    return F.array(*[F.lit(v) for v in values])


class Views:
    """Lazily built views over one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, df: DataFrame, rows_of_task: int | None = None) -> DataFrame:
        """Rows dealt over all cores when the scan has fewer splits than cores; larger tables stay as they are.

        ``rows_of_task``: where a row makes much work, a split may not hold many more rows than that (they are counted from
        the footers of the files).
        """
        parts = self.spark.sparkContext.defaultParallelism
        if rows_of_task:
            parts = max(parts, -(-df.count() // rows_of_task))
        return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df

    @property
    def rgb(self):
        return F.col("r"), F.col("g"), F.col("b")

    @cached_property
    def pixels(self) -> DataFrame:
        """image_id, x, y, r, g, b: one 8 x 8 image per embedding."""
        cells = self.spread(self.table("embeddings").select("vec_id", "embedding")).select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "e"))
        v = F.least(F.greatest(F.floor((F.col("e").cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int")
        cells = cells.select("image_id", (F.col("p") % 8).cast("int").alias("x"),
                             F.floor(F.col("p") / 8).cast("int").alias("y"), v.alias("v"))
        return cells.select("image_id", "x", "y", F.col("v").alias("r"),
                            ((F.col("v") * 3 + F.col("x") * 17) % 256).alias("g"),
                            ((F.col("v") * 5 + F.col("y") * 29) % 256).alias("b"))

    @cached_property
    def depth(self) -> DataFrame:
        """frame_id, x, y, mm: depth readings, 0 and 65535 mean no reading."""
        p = self.pixels
        mm = (F.when((p.r + p.g) % 7 == 0, 0).when((p.r + p.b) % 31 == 0, 65535)
              .otherwise(500 + p.r * 8 + p.b).cast("int"))
        return p.select(p.image_id.alias("frame_id"), "x", "y", mm.alias("mm"))

    @cached_property
    def pixels_long(self) -> DataFrame:
        """One lineitem row per pixel; the image is the order."""
        t = self.table("lineitem")
        return t.select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("x"),
                        ((F.col("l_quantity") * 5).cast("int") % 256).alias("r"),
                        (F.col("l_partkey") % 256).cast("int").alias("g"),
                        (F.col("l_suppkey") % 256).cast("int").alias("b"))

    @cached_property
    def blobs(self) -> DataFrame:
        """image_id, blob_id, bounding box, area, center, type."""
        t = self.spread(self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"))
        b = t.select(
            F.col("l_orderkey").alias("image_id"),
            ((F.col("l_partkey") * 100000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("blob_id"),
            (F.col("l_partkey") % 600).cast("int").alias("x"), (F.col("l_suppkey") % 400).cast("int").alias("y"),
            F.col("l_quantity").cast("int").alias("w"), (F.col("l_linenumber") * 7 + 1).alias("h"),
            F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 4).otherwise(1).alias("type"))
        return b.select("image_id", "blob_id", "x", "y", "w", "h", (F.col("w") * F.col("h")).alias("area"),
                        (F.col("x") + F.floor(F.col("w") / 2).cast("int")).alias("cx"),
                        (F.col("y") + F.floor(F.col("h") / 2).cast("int")).alias("cy"), "type")

    @cached_property
    def contours(self) -> DataFrame:
        """image_id, blob_id, contour: 24 ordered points per order, kept as one bounded array."""
        o = self.spread(self.table("orders").select("o_orderkey", "o_custkey"), CONTOURS_OF_TASK)
        radius = lambda i: 20 + (F.col("o_orderkey") * 31 + F.col("o_custkey") * 17 + i * 7) % 10
        at = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)
        point = lambda i: F.struct(
            (100 + F.floor(radius(i) * at(COS24, i) / 1000.0)).cast("int").alias("x"),
            (100 + F.floor(radius(i) * at(SIN24, i) / 1000.0)).cast("int").alias("y"))
        return o.select(F.col("o_custkey").alias("image_id"), F.col("o_orderkey").alias("blob_id"),
                        F.transform(F.sequence(F.lit(0), F.lit(23)), point).alias("contour"))

    @cached_property
    def factors(self) -> DataFrame:
        """Factor table: one row per blob with scalar factors, predicted type and actual type."""
        t = self.table("lineitem")
        return t.select(
            F.format_string("image-%d-blob%d", F.col("l_orderkey"), F.col("l_partkey")).alias("name"),
            F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("number"),
            F.col("l_quantity").alias("hue"), F.col("l_discount").alias("saturation_mean"),
            F.col("l_tax").alias("in_phase"), (F.col("l_extendedprice") / 1000).alias("shape_index"),
            (F.col("l_partkey") % 100).cast("double").alias("compactness"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("type"),
            F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("actual"))

    @cached_property
    def vectors(self) -> DataFrame:
        """id, features (all 64 doubles of a vector), type: a numeric training set."""
        t = self.table("embeddings")
        return t.select(F.col("vec_id").alias("id"),
                        F.transform("embedding", lambda e: e.cast("double")).alias("features"),
                        F.when(F.col("label") < 2, 0).otherwise(1).alias("type"))

    @cached_property
    def predictions(self) -> DataFrame:
        """technique, image_id, type (predicted), actual, score."""
        t = self.table("lineitem")
        return t.select(
            F.element_at(_strings(TECHNIQUES), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("technique"),
            F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("blob_id"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("type"),
            F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("actual"),
            ((F.floor(F.col("l_extendedprice")) * 7 % 997) / 997.0).alias("score"))

    @cached_property
    def results(self) -> DataFrame:
        """Sweep results: six scores, parameters and status per row."""
        p = self.table("part")
        k = F.col("p_partkey")
        return p.select(
            k.alias("id"), F.element_at(_strings(TECHNIQUES), (k % 10 + 1).cast("int")).alias("technique"),
            F.element_at(_strings(CORRECTIONS), F.col("p_size") % 4 + 1).alias("correction"),
            ((k * 37 + 11) % 101 / 100.0).alias("accuracy"), ((k * 53 + 7) % 97 / 100.0).alias("auc"),
            ((k * 29 + 3) % 89 / 100.0).alias("precision"), ((k * 41 + 5) % 83 / 100.0).alias("recall"),
            ((k * 61 + 13) % 79 / 100.0).alias("f1"), ((k * 37 + 11) % 101 / 100.0).alias("map"),
            F.array(*[F.element_at(_strings(PARAMETERS), ((k * a + b) % 16 + 1).cast("int")) for a, b in ((7, 0), (11, 3), (13, 5))])
            .alias("parameters"),
            F.when(k % 7 == 0, 1).otherwise(2).alias("status"))

    @cached_property
    def season(self) -> DataFrame:
        """type, date (month), hue, saturation_mean."""
        o = self.table("orders")
        return o.select(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0).alias("type"),
                        F.trunc("o_orderdate", "month").alias("date"), F.floor("o_totalprice").cast("double").alias("hue"),
                        (F.col("o_custkey") % 100).cast("double").alias("saturation_mean"))

    @cached_property
    def images(self) -> DataFrame:
        """Image documents."""
        o, c = self.table("orders"), self.table("customer")
        j = o.join(c, o.o_custkey == c.c_custkey)
        return j.select(
            F.col("o_orderkey").alias("image_id"), F.format_string("image-%d", F.col("o_orderkey")).alias("name"),
            F.concat(F.lit("image://"), F.col("o_orderkey").cast("string")).alias("url"),
            ((F.col("o_orderkey") % 180) - 90 + (F.col("o_custkey") % 1000) / 1000.0).alias("lat"),
            ((F.col("o_custkey") % 360) - 180 + (F.col("o_orderkey") % 1000) / 1000.0).alias("long"),
            (F.col("o_custkey") % 1000).cast("double").alias("altitude"), F.lower("c_mktsegment").alias("crop"),
            F.col("o_orderdate").alias("acquired"), (F.col("o_orderkey") % 5000).alias("hash"))

    @cached_property
    def odometry(self) -> DataFrame:
        """device, ts, event_id, angle reading, sequence: encoder readings per device."""
        e = self.table("events")
        return e.select(F.col("user_id").alias("device"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("kind"),
                        F.floor(F.col("value") * 10).cast("double").alias("angle"),
                        (F.floor(F.col("event_id") / 100) - 1).alias("sequence"))

    @cached_property
    def perf_log(self) -> DataFrame:
        e = self.table("events")
        return e.select(F.col("event_type").alias("activity"), F.floor(F.col("value") * 1000).cast("long").alias("microseconds"))


# The same views as SQL text, for checking.
VIEW_SQL = {
    "pixels": """p0 as (select vec_id image_id, cast((i-1)%8 as int) x, cast((i-1)//8 as int) y,
  cast(least(greatest(floor((cast(embedding[i] as double)+1)*127.5),0),255) as int) v from embeddings, range(1,65) t(i)),
pixels as (select image_id, x, y, v r, (v*3+17*x)%256 g, (v*5+29*y)%256 b from p0)""",
    "depth": """depth as (select image_id frame_id, x, y,
  case when (r+g)%7=0 then 0 when (r+b)%31=0 then 65535 else 500+r*8+b end mm from pixels)""",
    "pixels_long": """pixels_long as (select l_orderkey image_id, l_linenumber x, cast(l_quantity*5 as int)%256 r,
  cast(l_partkey%256 as int) g, cast(l_suppkey%256 as int) b from lineitem)""",
    "blobs": """b0 as (select l_orderkey image_id, (l_partkey*100000+l_suppkey)*10+l_linenumber blob_id,
  cast(l_partkey%600 as int) x, cast(l_suppkey%400 as int) y, cast(l_quantity as int) w, l_linenumber*7+1 h,
  case l_returnflag when 'A' then 0 when 'N' then 4 else 1 end as "type" from lineitem),
blobs as (select image_id, blob_id, x, y, w, h, w*h area, x+w//2 cx, y+h//2 cy, "type" from b0)""",
    "contours": f"""contours as (select o_custkey image_id, o_orderkey blob_id, cast(i as int) i,
  cast(100+floor((20+(o_orderkey*31+o_custkey*17+i*7)%10)*{_list_sql(COS24)}[i+1]/1000.0) as int) x,
  cast(100+floor((20+(o_orderkey*31+o_custkey*17+i*7)%10)*{_list_sql(SIN24)}[i+1]/1000.0) as int) y
  from orders, range(24) t(i))""",
    "factors": """factors as (select 'image-'||l_orderkey||'-blob'||l_partkey as "name", l_orderkey image_id,
  l_linenumber number, l_quantity hue, l_discount saturation_mean, l_tax in_phase, l_extendedprice/1000 shape_index,
  cast(l_partkey%100 as double) compactness, case when l_returnflag='R' then 1 else 0 end as "type",
  case when l_linestatus='F' then 1 else 0 end actual from lineitem)""",
    "vectors": """vectors as (select vec_id id, list_transform(embedding, lambda e: cast(e as double)) features,
  case when label<2 then 0 else 1 end as "type" from embeddings)""",
    "predictions": f"""predictions as (select {_list_sql(TECHNIQUES)}[l_linenumber%4+1] technique, l_orderkey image_id,
  l_partkey blob_id, case when l_returnflag='R' then 1 else 0 end as "type",
  case when l_linestatus='F' then 1 else 0 end actual,
  (cast(floor(l_extendedprice) as bigint)*7%997)/997.0 score from lineitem)""",
    "results": f"""results as (select p_partkey id, {_list_sql(TECHNIQUES)}[p_partkey%10+1] technique,
  {_list_sql(CORRECTIONS)}[p_size%4+1] correction, ((p_partkey*37+11)%101)/cast(100 as double) accuracy,
  ((p_partkey*53+7)%97)/cast(100 as double) auc, ((p_partkey*29+3)%89)/cast(100 as double) "precision",
  ((p_partkey*41+5)%83)/cast(100 as double) recall, ((p_partkey*61+13)%79)/cast(100 as double) f1,
  ((p_partkey*37+11)%101)/cast(100 as double) as "map", [{_list_sql(PARAMETERS)}[(p_partkey*7)%16+1], {_list_sql(PARAMETERS)}[(p_partkey*11+3)%16+1],
  {_list_sql(PARAMETERS)}[(p_partkey*13+5)%16+1]] parameters,
  case when p_partkey%7=0 then 1 else 2 end status from part)""",
    "season": """season as (select case when o_orderstatus='O' then 1 else 0 end as "type",
  cast(date_trunc('month', o_orderdate) as date) as "date", floor(o_totalprice) hue,
  cast(o_custkey%100 as double) saturation_mean from orders)""",
    "images": """images as (select o_orderkey image_id, 'image-'||o_orderkey as "name", 'image://'||o_orderkey url,
  (o_orderkey%180)-90+(o_custkey%1000)/cast(1000 as double) lat,
  (o_custkey%360)-180+(o_orderkey%1000)/cast(1000 as double) long,
  cast(o_custkey%1000 as double) altitude, lower(c_mktsegment) crop, o_orderdate acquired, o_orderkey%5000 hash
  from orders join customer on o_custkey=c_custkey)""",
    "odometry": """odometry as (select user_id device, ts, event_id, event_type kind, floor(value*10) angle,
  cast(event_id//100-1 as bigint) as "sequence" from events)""",
    "perf_log": """perf_log as (select event_type activity, cast(floor(value*1000) as bigint) us from events)""",
}
_NEEDS = {"depth": ["pixels"]}


def with_views(body: str, *names: str) -> str:
    """``body`` with the named views as common table expressions. It starts with select, or with a comma and more of them."""
    ordered: list[str] = []
    for name in names:
        for view in [*_NEEDS.get(name, []), name]:
            if view not in ordered:
                ordered.append(view)
    if not ordered:
        return body
    start = "with recursive " if "union select" in body or "union all select nr." in body or "union all select cp." in body else "with "
    return start + ",\n".join(VIEW_SQL[n] for n in ordered) + ("" if body.lstrip().startswith(",") else "\n") + body
