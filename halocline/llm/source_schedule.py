"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

Slot i of the mix gets the golden-ratio point frac((i + 0.5) / phi) and, through the cumulative target shares, a source.
The documents of a source, shuffled by a hash of the id and laid end to end twice, are cut into blocks of equal numbers
of words; the r-th slot of a source takes its r-th block. Points of a low-discrepancy sequence fill every share evenly,
so a source has its number of slots to within a few, at every prefix of the mix.

Targets: the sources by code point, null last, weigh 5, 2, 1, repeating, and share `share` times all words; no target is
above `repeats` times its source's words, and what is above goes to the others by weight until none is above.

Cases: null and empty texts have no words and are not taken; a source without words has target 0; a null source is a
source of its own; rows equal in doc_id are ordered by their text's hash and size; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, source_key, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: Words of a block at most, and the slots that a source has on average at least where there are fewer words.
BLOCK_WORDS, SLOTS_PER_SOURCE = 8192, 1024
GOLDEN = 0.6180339887498949
SPACES = "\t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null: 0. Counts the starts of words without making them."""
    flat = F.concat(F.lit(" "), F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)))
    return F.regexp_count(flat, F.lit(" [^ ]")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) of sizes (source, source_size), a row a source."""
    w = sizes.withColumn("place", F.row_number().over(Window.orderBy(source_key(F.col("source")))) - 1)
    weight = F.lit(weights[-1])
    for i, x in enumerate(weights[:-1]):
        weight = F.when(F.col("place") % len(weights) == i, x).otherwise(weight)
    w = w.withColumn("weight", weight.cast("double")).withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    # Sources in order of cap / weight: the first ones are at their cap, the others share what is left by weight.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    all_rows = Window.partitionBy()
    w = (
        w.withColumn("total", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn("caps", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("caps")) / F.col("open"))
    )
    w = w.withColumn("at_level", F.col("cap") > F.col("level") * F.col("weight"))
    w = w.withColumn("final", F.min(F.when(F.col("at_level"), F.struct((F.col("cap") / F.col("weight")).alias("a"), F.col("place").alias("b"), F.col("level").alias("level")))).over(all_rows))
    return w.select("source", "source_size", F.when(F.col("cap") > F.coalesce(F.col("final.level"), F.lit(0.0)) * F.col("weight"), F.coalesce(F.col("final.level") * F.col("weight"), F.col("cap"))).otherwise(F.col("cap")).alias("target"))


def schedule(shares: DataFrame, n_slots: int, n_cells: int) -> DataFrame:
    """(slot, source, rank): the sources of slots 0 .. n_slots - 1 and each slot's rank within its source.

    Points find their source by an equi-join on cells of [0, 1); ranks are counted by runs of slots, then within them."""
    spark = shares.sparkSession
    order = Window.orderBy(source_key(F.col("source"))).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = shares.where("target > 0").withColumn("hi", F.sum("target").over(order)).withColumn("all", F.sum("target").over(Window.partitionBy()))
    edges = edges.select("source", ((F.col("hi") - F.col("target")) / F.col("all")).alias("lo"), F.when(F.col("hi") >= F.max("hi").over(Window.partitionBy()), F.lit(2.0)).otherwise(F.col("hi") / F.col("all")).alias("hi"))
    cell = lambda x: F.least(F.floor(x * n_cells), F.lit(n_cells - 1)).cast("long")
    cells = edges.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    points = spark.range(n_slots).withColumn("u", (F.col("id") + 0.5) * GOLDEN - F.floor((F.col("id") + 0.5) * GOLDEN)).withColumn("cell", cell(F.col("u")))
    slots = points.join(cells, "cell").where("lo <= u AND u < hi").select(F.col("id").alias("slot"), "source")
    slots = slots.withColumn("run", F.floor(F.col("slot") / 4096))
    runs = slots.groupBy("source", "run").agg(F.count("*").alias("n"))
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = slots.withColumn("nr", F.row_number().over(Window.partitionBy("source", "run").orderBy("slot")) - 1)
    joined = ranked.alias("a").join(runs.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.run") == F.col("b.run")))
    return joined.select("a.slot", "a.source", (F.col("b.before") + F.col("a.nr")).alias("rank"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): (doc_id, size, source_size, target, taken)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), F.xxhash64("doc_id", "text").alias("tie"))
    rows = staged(rows, "sizes")  # a few numbers a document: texts are read once
    n, words = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = staged(targets(sources, weights, share, repeats), "targets")
    n_sources = max(1, wanted.count())
    total = share * words
    block = int(max(1, min(BLOCK_WORDS, total // (n_sources * SLOTS_PER_SOURCE))))
    n_slots = int(round(total / block))

    # Where each document stands in its source's shuffled row: buckets of the hash first, then the rows of a bucket.
    n_buckets = max(1, n // 20_000)
    rows = rows.withColumn("deal", F.xxhash64(F.lit(9), "doc_id")).withColumn("bucket", F.floor((F.col("deal") / F.lit(2.0**64) + 0.5) * n_buckets).cast("long"))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    buckets = buckets.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy("source", "bucket").orderBy("deal", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    b, t = buckets.alias("b"), F.broadcast(wanted).alias("t") if n_sources <= 100_000 else wanted.alias("t")
    rows = rows.alias("a").join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket")))
    rows = rows.join(t, F.col("a.source").eqNullSafe(F.col("t.source")))
    rows = rows.select("a.doc_id", "a.source", "a.size", "t.source_size", "t.target", (F.col("b.before") + F.col("a.within")).alias("start"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "places")

    # Blocks of the source's row, laid `repeats` times, that a document has words in; a slot of that rank takes them.
    spans = rows.where("size > 0").select("row", "source", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda e: F.col("start") + e * F.col("source_size"))).alias("at"))
    spans = spans.select("row", "source", "size", "at", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("rank"))
    slots = schedule(wanted, n_slots, 16 * n_sources).drop("slot")
    met = spans.alias("a").join(slots.alias("s"), F.col("a.source").eqNullSafe(F.col("s.source")) & (F.col("a.rank") == F.col("s.rank")))
    part = F.least(F.col("a.at") + F.col("a.size"), (F.col("a.rank") + 1) * block) - F.greatest(F.col("a.at"), F.col("a.rank") * block)
    took = met.groupBy("a.row").agg(F.sum(part).alias("taken"))
    return rows.join(took, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes its words, to the nearest number of copies."""
    taken = staged(mix(docs).where("size > 0").select("doc_id", F.round(F.col("taken") / F.col("size")).cast("int").alias("copies__")).where("copies__ > 0").groupBy("doc_id").agg(F.max("copies__").alias("copies__")), "taken")
    joined = docs.join(bounded_broadcast(taken, taken.count()), "doc_id")
    return joined.withColumn("copy__", F.explode(F.sequence(F.lit(1), F.col("copies__")))).select(*docs.columns)
