"""Benchmark decontamination by SimHash over item-sized windows. DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words. Weights are how often a shingle occurs, and
the similarity of a window and an item is the sum of the smaller weights over the sum of the larger ones.

1. Shingles of the documents meet the shingles of the items (a stated, small table). A window with similarity s to an
   item of its size shares at least s/(1+s) of the shingles of both, so windows with fewer shared places are left out
   without loss. A best window may be taken to start at a shared shingle (moving on to it loses nothing), or to be the
   last of its document.
2. Of the shingles of a window that is left only those are looked up that the fewest items have, as many as a similar
   pair must share one of; that gives the items that a window may be like.
3. Windows get a fingerprint. It is cut into eight blocks of eight bits; an item is listed under every value within two
   bits of each of its blocks, so each window within RADIUS = 23 bits meets it in some block. So wide a radius selects
   little by itself: windows meet the blocks of the items of step 2 only, not those of all items of their size.
4. The fingerprints of those candidates are compared in full, then their shingles' weights. Windows that start up to
   the first shared shingle and are as similar as the best one go before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from leafspark.llm.shared import pick, write_table
from leafspark.operators.grouped import join_keys

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 23, 8
#: Places of a document whose marks are counted in one window.
CHUNK = 4096
#: Up to so many distinct item shingles (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_SHINGLES = 2_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashes_of(words: Column, width: int | Column) -> Column:
    """Hashes of the shingles; none if there are fewer words than the width."""
    n = F.size(words) - width + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(F.array().cast("array<bigint>"))


def spread_shingles(words: str, width: int) -> Column:
    """A generator (pos, s): a struct of the words at pos to pos + width - 1, null past the end. In generated code, for
    whole documents; xxhash64 of the struct's fields is what hashes_of gives."""
    shifted = [F.slice(words, i + 1, F.greatest(F.size(words), F.lit(1))).alias(f"w{i}") for i in range(width)]
    return F.posexplode(F.arrays_zip(*shifted)).alias("pos", "s")


def fingerprint_of(hashes: Column) -> Column:
    """Bit b is 1 if it is set in over half the hashes."""
    ones = lambda b: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.call_function("shiftright", h, b).bitwiseAND(F.lit(1).cast("long")).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: F.when(
        2 * ones(b) > F.size(hashes), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(acc))


def with_fingerprint(df: DataFrame, hashes: str, name: str) -> DataFrame:
    """The hashes are written first: in one plan with their fingerprints they would be made anew for each bit."""
    return write_table(write_table(df, "hashes").select("*", fingerprint_of(F.col(hashes)).alias(name)), "fingerprints")


def block_of(fp: Column, block: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * block).bitwiseAND(F.lit(255).cast("long")).cast("int")


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over sum of the larger weights of two arrays of shingle hashes."""
    times = lambda items, h: F.size(F.filter(items, lambda x: x == h))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, h: n + F.least(times(a, h), times(b, h)))
    return shared / (F.size(a) + F.size(b) - shared)


def item_table(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, n, width, item_hashes, item_fp): items without words are left out."""
    src = pick(items, item_id=id_col, text=text_col).select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    src = src.select("item_id", "words", F.size("words").alias("n"), F.least(F.size("words"), F.lit(SHINGLE)).alias("width"))
    src = src.select("item_id", "n", "width", hashes_of(F.col("words"), F.col("width")).alias("item_hashes"))
    return with_fingerprint(src, "item_hashes", "item_fp")


def lead_of(n: Column, similarity: float) -> Column:
    """Words by which a window may start earlier and still be similar: no more than shingles may differ."""
    return F.floor(n * (1 - similarity) / (1 + similarity) + 1).cast("int")


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, start_word, bits, similarity): each item of which a document has a window of at least the
    similarity; the best window, the first of equal ones. bits is the distance of the window at which the search met the
    item, which starts with a word of the first shared shingle.

    A window has as many words as the item, or is the whole of a shorter document. Items of fewer than five words are
    one shingle as a whole. Null and empty texts, on either side, give nothing; rows that repeat doc_id and text count
    once; a null doc_id is kept.
    """
    table = item_table(items)
    shingles = table.select("n", "width", F.explode("item_hashes").alias("h")).distinct()
    facts = shingles.agg(F.count("*"), F.collect_set("width")).first()  # at most five widths
    if not facts[0]:
        return docs.sparkSession.createDataFrame([], _schema(docs, id_col, items))
    if facts[0] <= BROADCAST_SHINGLES:
        shingles = F.broadcast(shingles)
    src = pick(docs, doc_id=id_col, text=text_col).where("text is not null")
    src = src.select("doc_id", F.xxhash64("text").alias("row"), words_of(F.col("text")).alias("words"))
    src = src.select("*", F.size("words").alias("len"))
    hits = None
    for width in sorted(facts[1]):
        spots = src.where(F.col("len") >= width).select("doc_id", "row", "words", "len", spread_shingles("words", width)).where(F.col(f"s.w{width - 1}").isNotNull())
        spots = spots.select("doc_id", "row", "words", "len", "pos", F.xxhash64("s.*").alias("h"))
        met = spots.join(shingles.where(F.col("width") == width).drop("width"), "h")
        start = F.least("pos", F.greatest(F.lit(0), F.col("len") - F.col("n")))
        lead = F.least(start, lead_of(F.col("n"), similarity))
        met = met.select("doc_id", "row", "n", "pos", F.lit(width).alias("width"), start.alias("start"), F.least("n", "len").alias("size"),
                         F.slice("words", start - lead + 1, lead + F.col("n")).alias("window"))
        hits = met if hits is None else hits.union(met)
    return _verified(_windows(hits, similarity), table, similarity)


def _windows(hits: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, row, n, width, start, window): distinct windows that share enough places with items of their size.

    Marks at the first place of a window, at shared places and at the last place of a window are counted in order, so
    no document's places are gathered.
    """
    last = F.col("start") + F.col("size") - F.col("width")
    mark = lambda at, kind, window: F.struct(at.alias("at"), F.lit(kind).alias("kind"), window.alias("window"))
    none = F.lit(None).cast("array<string>")
    marks = hits.select("doc_id", "row", "n", "width", "size", "start", F.explode(F.array(mark(F.col("start"), 0, F.col("window")), mark(F.col("pos"), 1, none), mark(last, 2, none))).alias("m"))
    marks = marks.select("doc_id", "row", "n", "width", "size", "start", "m.*")
    # Marks are counted in chunks of a document's places; a chunk begins with what the chunks before it have.
    marks = marks.withColumn("chunk", F.floor(F.col("at") / CHUNK))
    keys, one = ["doc_id", "row", "n"], F.sum((F.col("kind") == 1).cast("int"))
    sums = marks.groupBy(*keys, "chunk").agg(one.alias("inside"))
    sums = sums.select(*keys, "chunk", (F.sum("inside").over(Window.partitionBy(*keys).orderBy("chunk")) - F.col("inside")).alias("earlier"))
    order = Window.partitionBy(*keys, "chunk").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = join_keys(marks.withColumn("here", one.over(order)), sums, [*keys, "chunk"]).withColumn("so_far", F.col("earlier") + F.col("here"))
    windows = counted.where("kind <> 1").groupBy("doc_id", "row", "n", "width", "size", "start").agg(
        F.max(F.when(F.col("kind") == 2, F.col("so_far"))).alias("after"), F.min(F.when(F.col("kind") == 0, F.col("so_far"))).alias("before"), F.first("window", ignorenulls=True).alias("window"))
    both = F.col("n") + F.col("size") - 2 * F.col("width") + 2
    return windows.where(F.col("after") - F.col("before") >= F.lit(similarity / (1 + similarity)) * both - 1e-9).select("doc_id", "row", "n", "width", "start", "window")


def _verified(windows: DataFrame, table: DataFrame, similarity: float) -> DataFrame:
    lead = F.least("start", lead_of(F.col("n"), similarity))
    size = F.col("n") - F.col("width") + 1  # a window of a shorter document has fewer shingles
    windows = windows.select("doc_id", "row", "n", "start", lead.alias("lead"), size.alias("places"), hashes_of(F.col("window"), F.col("width")).alias("run"))
    windows = windows.withColumn("hashes", F.slice("run", F.col("lead") + 1, F.col("places")))
    windows = with_fingerprint(windows, "hashes", "fp")
    masks = [0] + [1 << i for i in range(8)] + [(1 << i) | (1 << j) for i in range(8) for j in range(i)]
    key = F.xxhash64("item_id", "item_hashes").alias("item_key")
    blocks = lambda fp: F.posexplode(F.array(*[block_of(F.col(fp), b) for b in range(BLOCKS)])).alias("block", "value")
    index = table.select("n", "item_fp", key, blocks("item_fp"))
    index = index.select("n", "item_fp", "item_key", "block", F.explode(F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    near = _alike(windows, table.select("n", key, "item_hashes"), similarity)
    asked = join_keys(windows, near, ["doc_id", "row", "n", "start"])
    met = asked.select("doc_id", "n", "start", "lead", "places", "run", "hashes", "fp", "item_key", blocks("fp")).join(index, ["item_key", "n", "block", "value"])
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).cast("int")
    met = met.select("doc_id", "start", "lead", "places", "run", "hashes", "item_key", bits.alias("bits"), "block", F.col("fp").bitwiseXOR(F.col("item_fp")).alias("off")).where(F.col("bits") <= RADIUS)
    # A pair that meets in several blocks goes on from the first of them.
    first = F.lit(True)
    for b in range(BLOCKS):
        first = first & ((F.col("block") <= b) | (F.bit_count(block_of(F.col("off"), b)) > 2))
    met = met.where(first).join(table.select(key, "item_id", "item_hashes"), "item_key")
    found = met.withColumn("similarity", weighted_similarity(F.col("hashes"), F.col("item_hashes"))).where(F.col("similarity") >= similarity - 1e-9)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "bits", "lead", "places", "run", "item_hashes")).alias("b"))
    earlier = F.filter(F.sequence(F.lit(0), F.col("b.lead")), lambda k: weighted_similarity(
        F.slice("b.run", F.col("b.lead") - k + 1, F.col("b.places")), F.col("b.item_hashes")) == F.col("b.similarity"))
    return best.select("doc_id", "item_id", (-F.col("b.back") - F.array_max(earlier)).alias("start_word"), F.col("b.bits").alias("bits"), F.col("b.similarity").alias("similarity"))


def _alike(windows: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, row, n, start, item_key): the items of its size that a window shares one of its rarest shingles with.

    A pair of m places each must share 2s/(1+s) of them, so one of any m - that + 1 places of the window is shared: those
    are taken whose shingles the fewest items have. Places are ordered within one window, which is as long as an item.
    """
    held = items.select("n", "item_key", F.explode("item_hashes").alias("h")).distinct()
    common = held.groupBy(F.col("n").alias("n2"), F.col("h").alias("h2")).agg(F.count("*").alias("items"))
    places = windows.select("doc_id", "row", "n", "start", F.size("hashes").alias("m"), F.explode("hashes").alias("h"))
    places = places.join(common, (F.col("n") == F.col("n2")) & (F.col("h") == F.col("h2")), "left").fillna(0, ["items"])
    rank = F.row_number().over(Window.partitionBy("doc_id", "row", "n", "start").orderBy("items", "h"))
    rare = places.withColumn("rank", rank).where(F.col("rank") <= F.col("m") - F.ceil(2 * similarity / (1 + similarity) * F.col("m") - 1e-9) + 1)
    return rare.where("items > 0").select("doc_id", "row", "n", "start", "h").distinct().join(held, ["n", "h"]).select("doc_id", "row", "n", "start", "item_key").distinct()


def _schema(docs: DataFrame, id_col: str, items: DataFrame) -> str:
    return f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, start_word int, bits int, similarity double"
