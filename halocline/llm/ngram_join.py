"""Exact n-gram Jaccard join with filters under several global token orders.

A document's tokens are the 64-bit hashes of its distinct 5-word shingles. Two sets of Jaccard similarity t or more share
a token among their first n - ceil(t n) + 1 tokens under any global order of the tokens, so a candidate pair must share
prefix tokens under every order that is used:

- order A: by document frequency, rarest first. Frequencies are counted for a fixed region of the hash space, which holds
  more tokens of a document than its prefix needs; the rest of the space follows by hash. A token that one document has
  alone takes its place in the prefix but needs no index entry, so a document whose prefix has only such tokens is done.
  Among the documents that are left, the order is taken again with the frequencies of all tokens.
- order B: by descending hash, over whole sets;
- order C: by ascending hash with its halves exchanged, over whole sets.

Equal texts are one class from the start. What shares a prefix token under A (and keeps A's length and position bounds)
is tried in two ways, and under both a candidate must share prefix tokens under B and C too before the whole sets are
compared:

- in the first rounds a token's documents are only tried against one of them, so a group of near copies takes as many
  pairs as it has documents; links merge components, and tokens whose documents share one are done;
- then what is left of each token, documents of different components, is compared in blocks of about half of
  `BLOCK_SETS` sets and `BLOCK_TOKENS` tokens. A task takes two blocks, finds common tokens by products of 0/1 matrices and
  returns which components meet; no row is made for a pair. So no link between different components is missed.

Links are counted afterwards: as linked classes share a component, every pair of classes within a component is verified,
in blocks too.

Cases: null texts and texts without words have no shingles and are linked with nothing; with fewer than five words the
whole sequence is the one shingle; equal texts share a component; rows equal in doc_id count as one document, that of
the least text hash; a row without doc_id gets its n_shingles, no class or component, as none could be named, and no links;
texts of any length are taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, chunks, discard, small_batches, staged, text_bytes

WORDS = 5
PERCENT = 75
#: Share of the hash space in which document frequencies are counted.
REGION = 0.35
REGION_END = int(-(2**63) + REGION * 2**64)
SALTS = 16
#: Rounds that try a token's documents against one of them, at most.
HUB_ROUNDS = 3
#: Twice what a block of sets holds on average, as sets are dealt to blocks by hash.
BLOCK_SETS, BLOCK_TOKENS = 1024, 1 << 18
#: Index rows that a task looks for partners in, on average.
TASK_ROWS = 20_000
#: Token columns of a 0/1 matrix at once.
COLUMNS = 4096

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    value = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    value[65:91] = value[97:123]
    return value


VALUE = _byte_values()
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))
MIXER = np.uint64(0x9FB21C651E98DF25)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n+1 offsets): the shingles of every text in order, as signed 64-bit hashes, repeats included."""
    n = len(offsets) - 1
    solid = ~BLANK[data]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    before[offsets[:-1][np.diff(offsets) > 0]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[offsets[1:][np.diff(offsets) > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    power = np.full(len(data) + 1, BASE, np.uint64)
    power[:1] = 1
    np.multiply.accumulate(power, out=power)
    inverse = np.full(len(data) + 1, INVERSE, np.uint64)
    inverse[:1] = 1
    np.multiply.accumulate(inverse, out=inverse)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUE[data] * power[:-1], out=total[1:])
    word = _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)  # words of each text
    count = np.diff(first)
    shingle_count = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(shingle_count)])
    index = np.arange(at[-1]) - np.repeat(at[:-1] - first[:-1], shingle_count)
    length = np.repeat(np.minimum(count, words), shingle_count)
    padded = np.concatenate([word, np.zeros(words, np.uint64)])
    out = length.astype(np.uint64)
    for k in range(words):
        out = np.where(k < length, _mix(out * MIXER + padded[index + k]), out)
    return out.view(np.int64), at


def prefix_length(n: np.ndarray) -> np.ndarray:
    """n - ceil(t n) + 1, or 0 for empty sets."""
    return np.where(n > 0, n + (PERCENT * n) // -100 + 1, 0)


def _listed(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def _signature(text: bytes) -> bytes:
    return hashlib.md5(b" ".join(text.translate(_LOWER).split()), usedforsecurity=False).digest()


def _map_sets(docs: DataFrame, make, schema: str) -> DataFrame:
    """make(sorted distinct hashes) -> values, for every text; rows (doc_id, sig, n, *values)."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets, 1 << 19):
                d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                hashes, at = shingles(d, o)
                sets = [np.unique(hashes[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
                sigs = [_signature(d[x:y].tobytes()) for x, y in zip(o[:-1], o[1:], strict=True)]
                columns = make(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sigs, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), *columns], names)

    names = [x.split()[0] for x in schema.split(", ")]
    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def _frequent_region(sets: list[np.ndarray]) -> list:
    """What is indexed of each set: its tokens in the region, or its prefix by hash where that is longer."""
    kept = [s[: max(int(np.searchsorted(s, REGION_END)), int(prefix_length(np.array(len(s)))))] for s in sets]
    return [_listed(kept)]


def _sizes(sets: list[np.ndarray]) -> list:
    """How many tokens of each set are indexed."""
    return [pa.array([max(int(np.searchsorted(s, REGION_END)), int(prefix_length(np.array(len(s))))) for s in sets], pa.int32())]


def _whole(sets: list[np.ndarray]) -> list:
    return [_listed(sets)]


def late_prefix(s: np.ndarray) -> np.ndarray:
    """The prefix under order B of an ascending set."""
    return s[len(s) - int(prefix_length(np.array(len(s)))) :]


def turned_prefix(s: np.ndarray) -> np.ndarray:
    """The prefix under order C."""
    u = s.view(np.uint64)
    order = ((u << np.uint64(32)) | (u >> np.uint64(32))).view(np.int64)
    n = int(prefix_length(np.array(len(s))))
    return s[np.argpartition(order, n - 1)[:n]] if n < len(s) else s


def _late(toks: str, n: str):
    return F.slice(toks, -(F.col(n) - F.ceil(F.col(n) * PERCENT / 100) + 1).cast("int"), (F.col(n) - F.ceil(F.col(n) * PERCENT / 100) + 1).cast("int"))


def _turned(toks: str, n: str):
    turned = F.array_sort(F.transform(toks, lambda t: F.shiftleft(t, 32).bitwiseOR(F.shiftrightunsigned(t, 32))))
    return F.slice(turned, 1, (F.col(n) - F.ceil(F.col(n) * PERCENT / 100) + 1).cast("int"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges (u, v) reaches; alternating large and small stars, staged each time."""

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if small:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        if small:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        else:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.where("u <> v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = staged(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = mark(edges)
    while state[0]:
        edges = staged(star(star(edges, False), True), "edges")
        new = mark(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The number of common tokens of every set of a with every set of b; the tokens of a set are distinct."""
    tokens = np.intersect1d(np.concatenate(a), np.concatenate(b))
    places = []
    for sets in (a, b):
        whole = np.concatenate(sets)
        at = np.minimum(np.searchsorted(tokens, whole), max(0, len(tokens) - 1))
        hit = tokens[at] == whole if len(tokens) else np.zeros(len(whole), bool)
        column, row = at[hit], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]
        order = np.argsort(column, kind="stable")
        places.append((column[order], row[order], len(sets)))
    out = np.zeros((len(a), len(b)), np.float64)
    for start in range(0, len(tokens), COLUMNS):
        width, parts = min(COLUMNS, len(tokens) - start), []
        for column, row, n in places:
            x, y = np.searchsorted(column, [start, start + width])
            part = np.zeros((n, width), np.float32)  # sums of ones up to `COLUMNS` are exact
            part[row[x:y], column[x:y] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _sets(rows: pa.Table) -> list[np.ndarray]:
    toks = rows.column("toks").combine_chunks()
    data, ends = toks.values.to_numpy(), toks.offsets.to_numpy()
    return [data[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]


def _groups(rows: pa.Table) -> list[np.ndarray]:
    """Row numbers of every (tok, x, y) among the rows."""
    tok, x, y = (rows.column(c).to_numpy() for c in ("tok", "x", "y"))
    order = np.lexsort((y, x, tok))
    new = np.zeros(len(order), bool)
    for key in (tok[order], x[order], y[order]):
        new[1:] |= key[1:] != key[:-1]
    return np.split(order, np.flatnonzero(new))


def _may_link(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows i against rows j (broadcast): whether A's bounds let them link across components, and the overlap needed."""
    (n, m), room = (rows["n"][i], rows["n"][j]), np.minimum(rows["n"][i] - rows["pos"][i], rows["n"][j] - rows["pos"][j])
    need = -(-PERCENT * (n + m) // (100 + PERCENT))
    return (rows["comp"][i] != rows["comp"][j]) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)) & (1 + room >= need), need


ENTRY = ("tok", "x", "y", "block", "rep", "n", "pos", "comp")


def _with_partner(table: pa.Table) -> pa.Table:
    """The rows of groups (tok, x, y) that A's bounds let link with another of their group, block x against block y."""
    rows, groups = {c: table.column(c).to_numpy().astype(np.int64) for c in ENTRY}, _groups(table)
    keep = np.zeros(len(table), bool)
    twos = np.array([g for g in groups if len(g) == 2], np.int64).reshape(-1, 2)
    i, j = twos[:, 0], twos[:, 1]
    may = _may_link(rows, i, j)[0] & ((rows["x"][i] == rows["y"][i]) | (rows["block"][i] != rows["block"][j]))
    keep[twos[may].ravel()] = True
    for group in (g for g in groups if len(g) > 2):
        i, j = (group[rows["block"][group] == rows[side][group[0]]] for side in ("x", "y"))
        may = _may_link(rows, i[:, None], j[None, :])[0]
        keep[i[may.any(1)]] = keep[j[may.any(0)]] = True
    return table.filter(pa.array(keep)).select(ENTRY)


def _meetings(table: pa.Table) -> pa.Table:
    """(u, v): the components that meet in any of the block pairs (tok, x, y) among the rows; each pair of components once."""
    rows, sets, found = {c: table.column(c).to_numpy().astype(np.int64) for c in ENTRY}, _sets(table), set()
    for group in _groups(table):
        i, j = (group[rows["block"][group] == rows[side][group[0]]] for side in ("x", "y"))
        may, need = _may_link(rows, i[:, None], j[None, :])
        for prefix in (late_prefix, turned_prefix):
            if may.any():
                may &= _common([prefix(sets[k]) for k in i], [prefix(sets[k]) for k in j]) > 0
        if may.any():
            some, other = may.any(1), may.any(0)
            i, j, may, need = i[some], j[other], may[some][:, other], need[some][:, other]
            a, b = np.nonzero(may & (_common([sets[k] for k in i], [sets[k] for k in j]) >= need))
            u, v = rows["comp"][i[a]], rows["comp"][j[b]]
            found.update(zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist(), strict=True))
    u, v = zip(*sorted(found), strict=True) if found else ((), ())
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def meet_in_blocks(live: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of live (tok, rep, n, pos, comp): components with a link between documents that share a token, all of them.

    First the rows without a partner in A's bounds are left out, by small columns alone; then sets are joined."""
    load = live.groupBy("tok").agg(F.count("*").alias("rows"), F.greatest(F.ceil(F.count("*") / (BLOCK_SETS // 2)), F.ceil(F.sum("n") / (BLOCK_TOKENS // 2))).alias("blocks"))
    load = staged(load, "load")
    n_rows = load.agg(F.coalesce(F.sum(F.col("rows") * F.col("blocks")), F.lit(0))).first()[0]
    spread = live.join(load, "tok").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    spread = spread.select("tok", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rep", "n", "pos", "comp")
    dealt = lambda df, tasks: df.withColumn("task", F.pmod(F.xxhash64("tok", "x", "y"), F.lit(max(1, int(tasks))))).groupBy("task")
    rows = staged(dealt(spread, n_rows // TASK_ROWS).applyInArrow(_with_partner, "tok long, x int, y int, block int, rep long, n int, pos int, comp long"), "blocks")
    n_tokens = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return dealt(rows.join(sets.select("rep", "toks"), "rep"), n_tokens // (2 * BLOCK_TOKENS)).applyInArrow(_meetings, "u long, v long").distinct()


def _count_links(key: tuple, rows: pa.Table) -> pa.Table:
    """(rep, n_links) of two blocks x <= y of a component: the documents of linked classes, each pair of classes once."""
    block, reps, sizes = (rows.column(c).to_numpy() for c in ("block", "rep", "size"))
    sets = _sets(rows)
    x, y = key[1].as_py(), key[2].as_py()
    i, j = np.flatnonzero(block == x), np.flatnonzero(block == y)
    if not len(i) or not len(j):  # no class was dealt to the other block
        return pa.table({"rep": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64())})
    n = np.array([len(s) for s in sets], np.int64)
    common = _common([sets[k] for k in i], [sets[k] for k in j])
    linked = 100 * common >= PERCENT * (n[i][:, None] + n[j][None, :] - common)
    if x == y:
        np.fill_diagonal(linked, False)
        ids, found = reps[i], linked @ sizes[j]
    else:
        ids, found = np.concatenate([reps[i], reps[j]]), np.concatenate([linked @ sizes[j], sizes[i] @ linked])
    return pa.table({"rep": pa.array(ids, pa.int64()), "n_links": pa.array(found, pa.int64())})


def count_links(sets: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(rep, n_links): how many documents of other classes each class is linked with, of sets (rep, n, toks), labels (rep, comp) and the sizes (rep, size) of classes of several."""
    several = labels.groupBy("comp").agg(F.count("*").alias("reps")).where("reps > 1").select("comp")
    members = labels.join(several, "comp", "left_semi").join(sets.select("rep", "n"), "rep").join(sizes, "rep", "left").withColumn("size", F.coalesce("size", F.lit(1)).cast("long"))
    members = staged(members, "members")
    # Classes are dealt to blocks by hash, half full on average; no task ranks a whole component.
    load = members.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / (BLOCK_SETS // 2)), F.ceil(F.sum("n") / (BLOCK_TOKENS // 2))).alias("blocks"))
    spread = members.join(load, "comp").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    spread = spread.select("comp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "rep", "size")
    rows = spread.join(sets.select("rep", "toks"), "rep")
    return rows.groupBy("comp", "x", "y").applyInArrow(_count_links, "rep long, n_links long").groupBy("rep").agg(F.sum("n_links").alias("n_links"))


def join_documents(docs: DataFrame, count: bool = True) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, n_links): class_id is the least doc_id with the same words.

    n_links is the number of other documents that reach the similarity, those of the same class included; without `count`
    it isn't counted."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    # Classes of equal texts. Only groups of several are joined back, salted: a group may hold a third of all rows.
    every = staged(_map_sets(texts, _sizes, "doc_id long, sig binary, n int, m int"), "keys")
    texts, keyed = texts.where("doc_id IS NOT NULL"), every.where("doc_id IS NOT NULL")
    rows, ids = keyed.agg(F.count("*"), F.count_distinct("doc_id")).first()
    one = keyed if rows == ids else staged(keyed.groupBy("doc_id").agg(F.min(F.struct("sig", "n", "m")).alias("x")).select("doc_id", "x.*"), "keys")
    groups = one.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).where("size > 1")
    groups = groups.select("sig", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = staged(one.where("n > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(groups, ["sig", "salt"]).where("first < doc_id").select("doc_id", "sig", F.col("first").alias("rep")), "copies")
    n_copies = copies.count()

    def of_representatives(made: DataFrame) -> DataFrame:
        if rows != ids:
            made = made.dropDuplicates(["doc_id", "sig"]).join(one.select("doc_id", "sig"), ["doc_id", "sig"], "left_semi")
        return made.join(bounded_broadcast(copies.select("doc_id"), n_copies), "doc_id", "left_anti")

    # Order A: frequencies of the region's tokens; only tokens of two documents or more get into the index.
    # The join by token is left to a shuffle, whose skewed partitions Spark splits: the tokens grow with the documents, and
    # a broadcast up to some size would only hide that. Rows are narrow; the sizes of the sets are joined by document.
    indexed = of_representatives(_map_sets(texts, _frequent_region, "doc_id long, sig binary, n int, toks array<long>").where("n > 0"))
    entries = indexed.select(F.col("doc_id").alias("rep"), F.explode("toks").alias("tok"))
    sizes = one.select(F.col("doc_id").alias("rep"), "n", "m")
    shared = staged(entries.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    found = entries.join(shared, "tok")
    order = Window.partitionBy("rep").orderBy("outside", F.when(F.col("outside"), 0).otherwise(F.col("df")), "tok")
    placed = found.withColumn("outside", F.col("tok") >= F.lit(REGION_END)).withColumn("nth", F.row_number().over(order)).withColumn("both", F.count("*").over(Window.partitionBy("rep")))
    placed = placed.join(sizes, "rep").withColumn("pos", F.col("m") - F.col("both") + F.col("nth")).where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)
    index = staged(placed.select("tok", "rep", "n", F.col("pos").cast("int").alias("pos")), "index")

    # Whole sets of the documents that are in the index.
    busy = index.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    alive = staged(index.join(busy, "tok", "left_semi").select("rep").distinct(), "alive")
    discard(shared, index)
    n_alive = alive.count()
    wanted = texts.join(bounded_broadcast(alive.withColumnRenamed("rep", "doc_id"), n_alive), "doc_id", "left_semi")
    sets = staged(of_representatives(_map_sets(wanted, _whole, "doc_id long, sig binary, n int, toks array<long>")).drop("sig").withColumnRenamed("doc_id", "rep"), "sets")

    # Order A again, exactly: among the documents left, the frequencies of all their tokens are few enough to count.
    entries = sets.select("rep", F.explode("toks").alias("tok"))
    shared = staged(entries.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    placed = entries.join(shared, "tok").withColumn("nth", F.row_number().over(Window.partitionBy("rep").orderBy("df", "tok"))).withColumn("both", F.count("*").over(Window.partitionBy("rep")))
    placed = placed.join(sizes, "rep").withColumn("pos", F.col("n") - F.col("both") + F.col("nth")).where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)
    index = staged(placed.select("tok", "rep", "n", F.col("pos").cast("int").alias("pos")), "index")

    discard(shared)

    def sets_of(pairs: DataFrame) -> DataFrame:
        """The sets that the pairs name; the others need not be shuffled."""
        ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
        return sets.join(bounded_broadcast(ends, 2 * pairs.count()), "rep", "left_semi")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b): those that share prefix tokens under orders B and C too, and then reach the similarity."""
        whole = sets_of(pairs).select("rep", "n", "toks", _late("toks", "n").alias("late"), _turned("toks", "n").alias("turned"))
        side = lambda x: whole.select(*[F.col(c).alias(f"{c}_{x}") for c in ("n", "toks", "late", "turned")], F.col("rep").alias(x))
        met = pairs.join(side("a"), "a").join(side("b"), "b").where(F.arrays_overlap("late_a", "late_b") & F.arrays_overlap("turned_a", "turned_b"))
        common = F.size(F.array_intersect("toks_a", "toks_b")).cast("long")
        return met.withColumn("common", common).where(100 * F.col("common") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")

    def may_link(x: str, y: str):
        """The length bound and order A's position bound: overlap needed, and overlap possible from these positions on."""
        need = F.ceil(PERCENT * (F.col(f"{x}.n") + F.col(f"{y}.n")) / (100 + PERCENT))
        possible = 1 + F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
        return (100 * F.least(F.col(f"{x}.n"), F.col(f"{y}.n")) >= PERCENT * F.greatest(F.col(f"{x}.n"), F.col(f"{y}.n"))) & (possible >= need)

    def merged(labels: DataFrame, met: DataFrame) -> DataFrame:
        """labels (rep, comp) once the components (u, v) are one."""
        roots = components(met)
        return staged(labels.join(roots, F.col("comp") == F.col("node"), "left").select("rep", F.coalesce("root", "comp").alias("comp")), "labels")

    labels = staged(alive.withColumn("comp", F.col("rep")), "labels")
    tried, live = None, index
    for turn in range(HUB_ROUNDS + 1):
        members = live.select("tok", "rep", "n", "pos").join(labels, "rep")
        open_tokens = members.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct(F.xxhash64(F.lit(turn), "rep").alias("h"), "rep", "n", "pos", "comp")).alias("hub")).where("lo <> hi")
        open_tokens = staged(open_tokens, "open")
        # A token whose documents share a component has nothing left to try, now or later: components only grow.
        before, live = live, staged(members.join(open_tokens.select("tok"), "tok", "left_semi"), "live")
        discard(before)
        if turn == HUB_ROUNDS:
            labels = merged(labels, meet_in_blocks(live, sets))
            break
        hubs = open_tokens.select("tok", F.col("hub.rep").alias("rep"), F.col("hub.n").alias("n"), F.col("hub.pos").alias("pos"), F.col("hub.comp").alias("comp"))
        x, y = hubs.alias("x"), live.alias("y")
        pairs = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.comp") != F.col("y.comp")) & may_link("x", "y"))
        pairs = pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        discard(open_tokens)
        tried = pairs if tried is None else tried.union(pairs)
        links = staged(linked(pairs), "links")
        ends = links.join(labels.select(F.col("rep").alias("a"), F.col("comp").alias("u")), "a").join(labels.select(F.col("rep").alias("b"), F.col("comp").alias("v")), "b")
        labels = merged(labels, ends.select("u", "v"))

    nameless = every.where("doc_id IS NULL").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("component_id"))
    found = one.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(copies.select("doc_id", "rep"), "doc_id", "left").withColumn("class_id", F.coalesce("rep", "doc_id")).drop("rep")
    found = found.join(labels.select(F.col("rep").alias("class_id"), "comp"), "class_id", "left")
    # A component's name is its least doc_id, which is that of a class, as a class is named by its least.
    found = found.withColumn("component_id", F.coalesce("comp", "class_id"))
    if not count:
        return found.select("doc_id", "n_shingles", "class_id", "component_id").union(nameless)
    of_classes = copies.groupBy("rep").agg((F.count("*") + 1).alias("size"))
    counted = staged(count_links(sets, labels, of_classes), "counted").join(of_classes, "rep", "full").select(F.col("rep").alias("class_id"), (F.coalesce("n_links", F.lit(0)) + F.coalesce("size", F.lit(1)) - 1).alias("n_links"))
    counted = staged(counted.where("n_links > 0"), "counted")  # a row a class: a class of many documents is one key
    found = found.join(bounded_broadcast(counted, counted.count()), "class_id", "left")
    found = found.select("doc_id", "n_shingles", "class_id", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return found.union(nameless.withColumn("n_links", F.lit(0).cast("long")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, less those of documents that aren't the least of their component; rows without doc_id stay.

    What goes is joined away; it is broadcast where it is few, so that texts aren't shuffled."""
    gone = staged(join_documents(docs, count=False).where("doc_id <> component_id").select("doc_id"), "gone")
    return docs.join(bounded_broadcast(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
