"""Class-imbalance tools: splits, imbalance creation, synthetic minority rows and neighbour-based cleaning.

Tables: id (bigint), features (array of double), type (0 crop, 1 weed). Random choices are whole-number hashes of
ids, so a rerun after a lost executor gives the same rows. Made rows have negative ids.
"""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafspark.operators.grouped import ordered_scan, quantile_chunk, with_group_stats
from leafspark.operators.neighbors import nearest_neighbors, neighbor_rows
from leafspark.session import cut_lineage

SEED = 42


def hash_share(key: Column, seed: int = SEED) -> Column:
    """A number from 0 up to 1, in steps of 2^-32, from a key of any type. Keys close to each other are far apart here."""
    return _digits(F.concat_ws(":", key.cast("string"), F.lit(str(seed))), 8) / 4294967296.0


def _digits(text: Column, n: int) -> Column:
    """The first n hexadecimal digits of a text's MD5 as a number; other engines have the same function."""
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("long")


def split(df: DataFrame, train: float = 0.4, seed: int = SEED) -> DataFrame:
    """Adds ``is_train``: a 40/60 split by hash, no shuffle."""
    return df.withColumn("is_train", hash_share(F.col("id"), seed) < train)


def split_stratified(df: DataFrame, train: float = 0.4, seed: int = SEED) -> DataFrame:
    """Adds ``is_train`` with the same share in each class: the first rows of each class in hash order."""
    hashed = df.withColumn("_h", hash_share(F.col("id"), seed))
    ranked = ordered_scan(hashed, ["type"], ["_h", "id"], F.floor(F.col("_h") * 256), rank="_r")
    ranked = with_group_stats(ranked, ["type"], _n=F.count(F.lit(1)))
    return ranked.withColumn("is_train", F.col("_r") <= F.round(F.col("_n") * train)).select(*df.columns, "is_train")


def class_sizes(df: DataFrame) -> dict[int, int]:
    return {r["type"]: r["n"] for r in df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).collect()}


def create_imbalance(df: DataFrame, crop: float, weed: float, seed: int = SEED) -> DataFrame:
    """Drop weed rows until crop to weed is about ``crop`` to ``weed``; other requests leave the table as it is."""
    if crop <= weed or weed <= 0:
        return df
    counts = df.agg(F.struct(F.count_if(F.col("type") == 0).alias("crop"), F.count_if(F.col("type") == 1).alias("weed")).alias("s")).scalar()
    d = df.withColumn("_s", counts)
    share = F.col("_s.crop") / (crop / weed) / F.col("_s.weed")
    return d.filter((F.col("type") != 1) | (hash_share(F.col("id"), seed) <= share)).drop("_s")


def synthesise(seeds: DataFrame, pool: DataFrame, k: int = 5) -> DataFrame:
    """New rows between seeds and their neighbours in ``pool``. seeds: id, features, type, want (rows to make)."""
    seeds = cut_lineage(seeds)
    near = nearest_neighbors(seeds, pool, k, 2, exclude_self=True).filter(F.size("neighbors") > 0)
    made = seeds.filter("want > 0").join(near, F.col("id") == F.col("query_id")).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("want").cast("int"))))
    mix = F.concat_ws("-", "id", "j")
    pick = F.element_at("neighbors", (F.floor(hash_share(mix, 2) * F.size("neighbors")) + 1).cast("int"))["id"]
    made = made.select(F.col("id").alias("seed_id"), "j", "features", "type", pick.alias("mate"), hash_share(mix, 3).alias("u"))
    mates = pool.select(F.col("id").alias("mate"), F.col("features").alias("_f"))
    point = F.zip_with("features", "_f", lambda a, b: a + (b - a) * F.col("u"))
    return made.join(mates, "mate").select((-_digits(F.concat_ws("-", "seed_id", "j"), 15) - 1).alias("id"), point.alias("features"), "type")


def minority_of(df: DataFrame) -> tuple[int, int, int]:
    """(minority class, its size, size of the majority)."""
    sizes = class_sizes(df)
    if len(sizes) != 2:
        raise ValueError("two classes are needed")
    low = min(sizes, key=lambda c: (sizes[c], c))
    return low, sizes[low], sizes[1 - low]


def _even_wants(seeds: DataFrame, total: int) -> DataFrame:
    """Spread ``total`` new rows evenly over the seeds; the first ones in id order take the remainder."""
    seeds = cut_lineage(seeds)
    ranked = ordered_scan(seeds, [], ["id"], quantile_chunk(seeds, "id"), rank="_r")
    ranked = with_group_stats(ranked, [], _n=F.count(F.lit(1)))
    want = F.floor(F.lit(total) / F.col("_n")) + F.when(F.col("_r") <= F.lit(total) % F.col("_n"), 1).otherwise(0)
    return ranked.withColumn("want", want).select(*seeds.columns, "want")


def _rows(df: DataFrame) -> DataFrame:
    return df.select("id", "features", "type")


def smote(df: DataFrame, k: int = 5) -> DataFrame:
    low, n, top = minority_of(df)
    few = _rows(df).filter(F.col("type") == low)
    return _rows(df).unionByName(synthesise(_even_wants(few, top - n), few, k))


def _majority_share(df: DataFrame, few: DataFrame, low: int, k: int) -> DataFrame:
    """few with ``other``: how many of its k neighbours in the whole table are of the majority."""
    near = neighbor_rows(nearest_neighbors(few, df, k, 2, exclude_self=True)).join(df.select("id", "type"), "id")
    share = near.groupBy("query_id").agg(F.count_if(F.col("type") != low).alias("other"))
    return cut_lineage(few.join(share, F.col("id") == F.col("query_id")).drop("query_id"))


def adasyn(df: DataFrame, k: int = 5) -> DataFrame:
    """More new rows where the majority is near."""
    low, n, top = minority_of(df)
    few = _majority_share(df, _rows(df).filter(F.col("type") == low), low, k)
    few = with_group_stats(few, [], _t=F.sum("other"))
    want = F.when(F.col("_t") > 0, F.round(F.col("other") * (top - n) / F.col("_t"))).otherwise(0)
    pool = few.select("id", "features", "type")
    return _rows(df).unionByName(synthesise(few.withColumn("want", want).select("id", "features", "type", "want"), pool, k))


def borderline_smote(df: DataFrame, k: int = 5, m: int = 10) -> DataFrame:
    """New rows only around minority rows with half or more, but not all, of their neighbours in the majority."""
    low, n, top = minority_of(df)
    few = _rows(df).filter(F.col("type") == low)
    danger = _majority_share(df, few, low, m).filter((F.col("other") >= m / 2) & (F.col("other") < m)).select("id", "features", "type")
    return _rows(df).unionByName(synthesise(_even_wants(danger, top - n), few, k))


def kmeans_smote(df: DataFrame, clusters: int = 8, balance: float = 0.01, k: int = 5) -> DataFrame:
    """New rows inside clusters that hold enough of the minority; wants follow the minority count of the cluster."""
    low, n, top = minority_of(df)
    vectors = _rows(df).withColumn("v", array_to_vector("features"))
    placed = KMeans(k=clusters, seed=2, featuresCol="v", predictionCol="cluster").fit(vectors).transform(vectors).drop("v")
    placed = with_group_stats(placed, ["cluster"], _few=F.count_if(F.col("type") == low), _all=F.count(F.lit(1)))
    seeds = placed.filter((F.col("type") == low) & (F.col("_few") / F.col("_all") >= balance) & (F.col("_few") > 1))
    # Neighbours stay in the cluster: the cluster number, far apart, is one more dimension while searching.
    apart = F.concat(F.col("features"), F.array(F.col("cluster") * 1e6))
    seeds = _even_wants(seeds.select("id", apart.alias("features"), "type"), top - n)
    made = synthesise(seeds, seeds.drop("want"), k)
    return _rows(df).unionByName(made.withColumn("features", F.slice("features", F.lit(1), F.size("features") - 1)))


def svm_smote(df: DataFrame, k: int = 5, margin: float = 1.0) -> DataFrame:
    """New rows around minority rows inside the margin of a linear separator."""
    low, n, top = minority_of(df)
    vectors = _rows(df).withColumn("v", array_to_vector("features"))
    model = LinearSVC(featuresCol="v", labelCol="type", maxIter=50, regParam=0.01).fit(vectors)
    scored = model.transform(vectors).withColumn("_m", vector_to_array("rawPrediction")[1])
    few = scored.filter(F.col("type") == low).select("id", "features", "type", "_m")
    near = few.filter(F.abs("_m") <= margin).drop("_m")
    seeds = near if not near.isEmpty() else few.drop("_m")
    return _rows(df).unionByName(synthesise(_even_wants(seeds, top - n), few.drop("_m"), k))


def tomek_links(df: DataFrame) -> DataFrame:
    """Pairs of rows of different classes that are each other's nearest neighbour: id, mate."""
    near = nearest_neighbors(df, df, 1, 2, exclude_self=True).select(F.col("query_id").alias("id"), F.col("neighbors")[0]["id"].alias("mate"))
    back = near.select(F.col("mate").alias("id"), F.col("id").alias("mate"))
    types = df.select("id", "type")
    pairs = near.join(back, ["id", "mate"]).join(types, "id").join(types.select(F.col("id").alias("mate"), F.col("type").alias("_t")), "mate")
    return pairs.filter("type <> _t").select("id", "mate")


def remove_tomek(df: DataFrame) -> DataFrame:
    """Without the majority side of every link."""
    low, _, _ = minority_of(df)
    linked = tomek_links(df).select("id").join(df.filter(F.col("type") != low).select("id"), "id", "left_semi")
    return df.join(linked, "id", "left_anti")


def edited_neighbors(df: DataFrame, k: int = 3, both_classes: bool = False) -> DataFrame:
    """Without rows that have a neighbour of another class among the nearest k; only majority rows unless asked."""
    low, _, _ = minority_of(df)
    near = neighbor_rows(nearest_neighbors(df, df, k, 2, exclude_self=True))
    near = near.join(df.select("id", F.col("type").alias("_near")), "id")
    own = df.select(F.col("id").alias("query_id"), "type")
    bad = near.join(own, "query_id").filter("_near <> type")
    bad = bad if both_classes else bad.filter(F.col("type") != low)
    return df.join(bad.select(F.col("query_id").alias("id")).distinct(), "id", "left_anti")


def smote_tomek(df: DataFrame) -> DataFrame:
    return remove_tomek(cut_lineage(smote(df)))


def smote_enn(df: DataFrame) -> DataFrame:
    return edited_neighbors(cut_lineage(smote(df)), both_classes=True)


CORRECTIONS = {"SMOTE": smote, "SMOTETOMEK": smote_tomek, "SMOTEENN": smote_enn, "ADASYN": adasyn, "BORDERLINE": borderline_smote,
               "KMEANS": kmeans_smote, "SVM": svm_smote}


def correct(df: DataFrame, name: str) -> DataFrame:
    """Imbalance correction by name; NONE leaves the table as it is."""
    if name.upper() == "NONE":
        return _rows(df)
    return CORRECTIONS[name.upper()](df)
