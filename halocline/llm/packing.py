"""Packing by cutting-stock column generation.

Documents are cut into pieces of at most `capacity` tokens: whole sequences and one rest. Short rests are strung together
to bundles, which count as pieces here. The histogram of the pieces over length classes (a bounded table, however many
documents there are) is a cutting-stock instance. Its linear program is solved by the revised simplex method; a knapsack
dynamic program over the dual prices makes the columns. The solution is rounded down, what remains of each class (fewer
pieces than there are patterns and slots) is filled first fit decreasing, and the documents of a class, ranked, take the
slots of their class in pattern order.

Cases: null and empty texts have the end id alone; equal documents are packed one by one; ties in length are ranked by
doc_id, start and the piece's number; an empty table gives no rows; extra columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, staged
from .tokens import encoder

CAPACITY = 2048
#: Width of a length class in tokens; a piece wastes less than this.
GRAIN = 8
END_ID = 1

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, ids): the pieces of every text; ids are little-endian unsigned 32-bit."""

    def cut(batches):
        coder, end = encoder(vocabulary), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.encode(text.as_py()) + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for values, value in zip(rows, (doc_id, start, len(part) // 4, zlib.crc32(part), n, part), strict=True):
                        values.append(value)
                if len(rows[0]) >= 2048:
                    yield _piece_batch(rows)
                    rows = [[] for _ in range(6)]
            if rows[0]:
                yield _piece_batch(rows)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def _piece_batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows[:5]] + [pa.array(rows[5], pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])


def _knapsack(price: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """The dearest unbounded filling of `units`; item k is k+1 units long. Returns its price and its counts."""
    best, last = np.zeros(units + 1), np.zeros(units + 1, int)
    for c in range(1, units + 1):
        m = min(c, len(price))
        worth = price[:m] + best[c - m : c][::-1]
        k = int(np.argmax(worth))
        best[c], last[c] = (worth[k], k + 1) if worth[k] > best[c - 1] else (best[c - 1], 0)
    counts, c = np.zeros(len(price), int), units
    while c > 0:
        if last[c]:
            counts[last[c] - 1] += 1
        c -= max(1, last[c])
    return float(best[units]), counts


def column_generation(demand: np.ndarray, max_columns: int = 6000) -> list[tuple[np.ndarray, float]]:
    """Patterns and their (fractional) numbers for demand[k] pieces of k+1 units in sequences of len(demand) units.

    The master's basis has one column for each class that is in demand; every new column replaces the one that the ratio
    test names. It ends within half a sequence, or a ten-thousandth, of the linear program's bound."""
    units, used = len(demand), np.flatnonzero(demand)
    m = len(used)
    if not m:
        return []
    need = demand[used] * (1 + 1e-6) + 1e-3 * np.random.default_rng(1).random(m)  # perturbed, or ties make the pivots cycle
    patterns = np.zeros((m, m))  # column j: pattern of basic variable j over the used classes
    np.fill_diagonal(patterns, units // (used + 1))
    inverse = np.diag(1 / np.diag(patterns))
    amount = inverse @ need
    for turn in range(max_columns):
        dual = inverse.sum(axis=0)
        price = np.zeros(units)
        price[used] = np.maximum(dual, 0)
        worth, counts = _knapsack(price, units)
        value = amount.sum()
        if value - value / worth < max(0.5, 1e-4 * value):  # Farley's bound: no plan needs fewer than value / worth
            break
        column = counts[used].astype(float)
        step = (inverse * column).sum(axis=1)
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        amount = amount - ratio[out] * step
        amount[out] = ratio[out]
        patterns[:, out] = column
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
        if turn % 500 == 499 and np.abs((patterns * amount).sum(axis=1) - need).max() > 1e-6 * need.max():
            break  # rounding errors: the plan below only rounds down what is there, so it stays whole
    found = []
    for j in range(m):
        full = np.zeros(units, int)
        full[used] = patterns[:, j].astype(int)
        found.append((full, max(0.0, float(amount[j]))))
    return found


def cutting_plan(demand: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(piece lengths in units in a sequence, longest first; number of such sequences) for all of the demand."""
    left, plan = demand.copy(), []
    for pattern, amount in column_generation(demand):
        times = int(amount + 1e-9)
        filled = pattern > 0
        if filled.any():
            times = min(times, int((left[filled] // pattern[filled]).min()))
        if times and filled.any():
            left -= times * pattern
            plan.append((tuple(int(k) + 1 for k in np.flatnonzero(pattern)[::-1] for _ in range(pattern[k])), times))
    rest = Counter()
    while left.any():  # first fit decreasing, one sequence at a time, equal sequences at once
        room, chosen, trial = len(demand), [], left.copy()
        while room and (fit := np.flatnonzero(trial[:room])).size:
            k = int(fit[-1])
            n = min(int(trial[k]), room // (k + 1))
            chosen += [k + 1] * n
            trial[k] -= n
            room -= n * (k + 1)
        each = Counter(chosen)
        times = min(int(left[k - 1]) // n for k, n in each.items())
        for k, n in each.items():
            left[k - 1] -= n * times
        rest[tuple(chosen)] += times
    return plan + sorted(rest.items(), reverse=True)


def _bucket(n_rows: int, rows_each: int) -> Column:
    """Buckets of some `rows_each` rows by hash, so that no task ranks all rows or a whole class."""
    return F.pmod(F.xxhash64("piece"), F.lit(max(1, n_rows // rows_each))).cast("int")


def _bundled(short: DataFrame, n_rows: int, size: int) -> DataFrame:
    """Pieces shorter than `size` strung together to bundles of about `size` tokens: `head` (a bundle's first piece), `bundle_length`, `inner` (offset in the bundle)."""
    rows = short.withColumn("bucket", _bucket(n_rows, 4096))
    order = Window.partitionBy("bucket").orderBy("doc_id", "start", "piece")
    rows = rows.withColumn("before", F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("bundle", F.floor(F.col("before") / F.lit(size)))
    whole = Window.partitionBy("bucket", "bundle")
    rows = rows.withColumn("bundle_length", F.sum("length").over(whole)).withColumn("inner", F.col("before") - F.min("before").over(whole))
    return rows.withColumn("head", F.min_by("piece", "before").over(whole)).drop("bucket", "before", "bundle")


def place(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """pieces (piece, doc_id, start, length, ...) with sequence_id and offset.

    Rounding to classes would waste much of a short piece, so pieces of under a sixteenth of a sequence are strung
    together without gaps first, and the plan is made over these bundles and the longer pieces."""
    size = capacity // 16
    is_short = F.col("length") < size
    n_short = pieces.where(is_short).count()
    if not n_short:
        return _place(pieces, capacity, grain)
    short, long = _bundled(pieces.where(is_short), n_short, size), pieces.where(~is_short)
    key = ["piece", "doc_id", "start", "length"]
    heads = short.where(F.col("piece") == F.col("head")).withColumn("length", F.col("bundle_length")).select(*key)
    items = _place(long.select(*key).unionByName(heads), capacity, grain).select(F.col("piece").alias("head"), "sequence_id", "offset")
    every = short.drop("bundle_length").unionByName(long.withColumn("inner", F.lit(0).cast("long")).withColumn("head", F.col("piece")))
    return every.join(items, "head").withColumn("offset", F.col("offset") + F.col("inner")).drop("head", "inner")


def _place(pieces: DataFrame, capacity: int, grain: int) -> DataFrame:
    """sequence_id and offset of pieces, by the plan over their length classes."""
    spark = pieces.sparkSession
    units = capacity // grain
    rows = pieces.withColumn("class", F.ceil(F.col("length") / F.lit(grain)).cast("int"))
    counts = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count("*").alias("n")).collect()}  # at most `units` rows
    demand = np.array([counts.get(k + 1, 0) for k in range(units)], int)
    plan = cutting_plan(demand)
    # A slot line: the pieces ranked [first, first + times) of a class stand at place `nth` of sequences base, base + 1, ...
    slots, taken, base = [], Counter(), 0
    for at, (lengths, times) in enumerate(plan):
        for nth, k in enumerate(lengths):
            slots.append((k, taken[k], times, base, at, nth))
            taken[k] += times
        base += times
    table = spark.createDataFrame(slots, "class int, first long, times long, base long, pattern int, nth int")  # at most (units + rest) patterns of units slots
    # Ranks within a class, with no task for a whole class: ids are dealt to buckets, whose sizes are summed up first.
    rows = rows.withColumn("bucket", _bucket(sum(counts.values()), 50_000))
    before = rows.groupBy("class", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = rows.withColumn("nr", F.row_number().over(Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "piece")) - 1).join(before.select("class", "bucket", "before"), ["class", "bucket"])
    ranked = ranked.withColumn("rank", F.col("nr") + F.coalesce("before", F.lit(0)))
    # The slot lines of a class in order of rank: the one that holds a rank is found in an array, without a range join.
    lines = table.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("first", "times", "base", "pattern", "nth"))).alias("lines"))
    placed = ranked.join(F.broadcast(lines), "class").withColumn("line", F.element_at(F.filter("lines", lambda x: x["first"] <= F.col("rank")), -1))
    placed = placed.withColumn("sequence_id", F.col("line.base") + F.col("rank") - F.col("line.first")).withColumn("nth", F.col("line.nth"))
    offsets = Window.partitionBy("sequence_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(offsets), F.lit(0)).cast("long")).drop("class", "bucket", "nr", "before", "rank", "lines", "line", "nth")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, pieces with sequence_id and offset), both keyed by `piece`. Texts are encoded once, into a table in the shared folder."""
    pieces = staged(token_pieces(docs, vocabulary, capacity).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    return pieces, place(pieces.drop("ids"), capacity)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences, without their padding; at most `capacity` pieces each."""
    joined = pieces.select("piece", "ids").join(placed.select("piece", "length", "sequence_id", "offset"), "piece")
    parts = joined.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", "n_tokens", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
