"""Quality classification by co-training on two views.

View one is the text's content: hashed trigrams of its bytes, the shares of kinds of characters, lines, and how many words
differ. View two is the page's metadata: language, source and their n_chars in steps; it reads nothing of the text. A
logistic classifier is fitted to each view on a sample of the labelled rows. In every round each view scores all rows outside that sample, and
the ones that it is most certain of, of either class in the proportion of the labels, join the other view's training rows.
Both are then calibrated on labelled rows set aside, and a document's log odds are the sum of the views' calibrated ones less
the prior's, which both hold.

A document is kept from the score on that `KEPT` of the good rows set aside reach, or from one half if that is less.

The fit takes at most about `labelled` labelled rows, those of the smallest hashes; the search for certain rows and the
scores cover every row and its whole text.

Cases: null and empty texts have zero content and are scored by the rest; a label that is null is none; a document labelled
twice counts by its lowest label; rows without doc_id are scored, but never taken as certain; without labels of both classes
every document scores 0.5 and is kept; equal rows get equal scores; ties in certainty go to the lower doc_id; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, chunks, small_batches, text_bytes

LABELLED = 3000
ROUNDS = 3
#: Rows that a view labels in a round, as a share of the labelled training rows.
GROWTH = 0.1
#: Share of the good labelled rows set aside that the threshold keeps; what is lost wrongly weighs more than what stays.
KEPT = 0.995
#: Buckets of ids that the tasks' best rows are ranked in first.
BUCKETS = 64
TRIGRAMS = 512
SOURCES, LANGS, SIZES = 16, 8, 18

UPPER, LOWER, DIGIT, BLANK, LINE, WIDE, SYMBOL = range(7)


def _kinds() -> np.ndarray:
    kind = np.full(256, SYMBOL, np.uint8)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = UPPER, LOWER, DIGIT, WIDE
    kind[[9, 11, 12, 13, 32]] = BLANK
    kind[10] = LINE
    return kind


KIND = _kinds()


def content_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(text, TRIGRAMS + 11): square roots of the trigrams' shares, shares of characters, and rates a word or line."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    out = np.zeros((n, TRIGRAMS + 11), np.float32)
    if len(data) > 2:
        d = data.astype(np.uint32)
        gram = ((d[:-2] * 0x9E3779B1 + d[1:-1] * 0x85EBCA6B + d[2:] * 0xC2B2AE35) & 0xFFFFFFFF) >> np.uint32(23)
        inside = np.arange(len(gram)) + 2 < offsets[1:][row[:-2]]
        counts = np.bincount(row[:-2][inside] * TRIGRAMS + gram[inside] % TRIGRAMS, minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        out[:, :TRIGRAMS] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    kinds = np.bincount(row * 7 + KIND[data], minlength=n * 7).reshape(n, 7)
    words = kinds[:, BLANK] + kinds[:, LINE] + 1
    out[:, TRIGRAMS : TRIGRAMS + 7] = kinds / np.maximum(1, size)[:, None]
    out[:, -4] = np.log1p(kinds[:, LINE]) / 5
    out[:, -3] = np.minimum(size / words, 40) / 10
    out[:, -2] = kinds[:, SYMBOL] / words
    for k in range(n):
        parts = data[offsets[k] : offsets[k + 1]].tobytes().split()
        out[k, -1] = len(set(parts)) / max(1, len(parts)) ** 0.9 if parts else 0.0
    return out


def metadata_view(langs: list, sources: list, sizes: list) -> np.ndarray:
    """(row, LANGS + SOURCES + SIZES): language and source by hash, and the length in powers of two."""
    out = np.zeros((len(langs), LANGS + SOURCES + SIZES), np.float32)
    for k, (lang, source, size) in enumerate(zip(langs, sources, sizes, strict=True)):
        out[k, zlib.crc32((lang or "").encode()) % LANGS] = 1
        out[k, LANGS + zlib.crc32((source or "").encode()) % SOURCES] = 1
        out[k, LANGS + SOURCES + min(SIZES - 1, max(0, int(size or 0)).bit_length())] = 1
    return out


ROW = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = [x.split()[0] for x in ROW.split(", ")]


def rows_of(docs: DataFrame) -> DataFrame:
    """The columns that the views read; n_chars is null where docs has none."""
    return docs.select(*[(F.col(n) if n in docs.columns else F.lit(None)).cast(t).alias(n) for n, t in map(str.split, ROW.split(", "))])


def views_of(batch: pa.RecordBatch):
    """(first row, content, metadata) for parts of a batch of `ROW`."""
    data, offsets = text_bytes(batch.column(1))
    for a, b in chunks(offsets):
        langs, sources, sizes = (batch.column(i).slice(a, b - a).to_pylist() for i in (2, 3, 4))
        yield a, content_view(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), metadata_view(langs, sources, sizes)


def _listed(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), pa.float32()))


def known_labels(labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    return known.groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("label"))


def sample_features(docs: DataFrame, known: DataFrame, labelled: int):
    """(doc_id, label, both views) of the bounded labelled sample, to the driver: about `labelled` rows of fixed width."""
    dice = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(dice < min(1.0, labelled / max(1, known.count())))
    assert labelled <= MAX_BROADCAST_ROWS

    def views(batches):
        for batch in batches:
            for a, content, metadata in views_of(batch):
                part = batch.slice(a, len(content))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(5), _listed(content), _listed(metadata)], ["doc_id", "label", "content", "metadata"])

    small_batches(docs.sparkSession)
    joined = rows_of(docs).join(F.broadcast(chosen), "doc_id").select(*NAMES, "label")
    return joined.mapInArrow(views, "doc_id long, label int, content array<float>, metadata array<float>").toPandas()


def most_certain(rows: DataFrame, weights: list[np.ndarray], taken: list[list[int]], n_good: int, n_bad: int):
    """(view, good, content, metadata) of the rows that each view is most certain of, among all but those it has taken.

    Each task keeps its own best, so no more than tasks times 2 (n_good + n_bad) rows of fixed width are shuffled; they are
    ranked by bucket of the id first, then the best of the buckets."""
    taken = [set(x) for x in taken]

    def best(batches):
        kept: dict[tuple, list] = {(view, good): [] for view in (0, 1) for good in (0, 1)}
        for batch in batches:
            for a, *views in views_of(batch):
                ids = batch.column(0).slice(a, len(views[0])).to_numpy(zero_copy_only=False)
                for view, good in kept:
                    z = margin(views[view], weights[view]) * (1 if good else -1)
                    most = n_good if good else n_bad
                    for k in np.lexsort((ids, -z)):
                        if z[k] <= 0 or len(kept[view, good]) >= most and z[k] < kept[view, good][most - 1][0]:
                            break
                        if ids[k] == ids[k] and int(ids[k]) not in taken[view]:
                            kept[view, good].append((float(z[k]), int(ids[k]), views[0][k], views[1][k]))
                    kept[view, good] = sorted(kept[view, good], key=lambda x: (-x[0], x[1]))[:most]
        rows = [(view, good, *x) for (view, good), found in kept.items() for x in found]
        if rows:
            view, good, z, ids, content, metadata = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(view, pa.int32()), pa.array(good, pa.int32()), pa.array(z), pa.array(ids, pa.int64()), _listed(np.array(content)), _listed(np.array(metadata))], ["view", "good", "z", "doc_id", "content", "metadata"])

    found = rows.mapInArrow(best, "view int, good int, z double, doc_id long, content array<float>, metadata array<float>")
    for groups in (("view", "good", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))), ("view", "good")):
        place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("z"), "doc_id"))
        found = found.withColumn("place", place).where(F.col("place") <= F.when(F.col("good") == 1, n_good).otherwise(n_bad))
    return found.toPandas().sort_values(["view", "good", "place"])


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 150, ridge: float = 1e-4) -> np.ndarray:
    """Weights (last: intercept) by accelerated gradient steps on standardised features, the classes weighing alike."""
    mean, spread = x.mean(0), x.std(0) + 1e-3
    z = np.concatenate([(x - mean) / spread, np.ones((len(x), 1), x.dtype)], 1).astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))
    step = 4 / np.einsum("ij,ij,i->", z, z, weight.astype(np.float32)) * 8
    w, ahead = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", z, ahead.astype(np.float32)), -30, 30)))
        gradient = np.einsum("ij,i->j", z, ((p - y) * weight).astype(np.float32)) + ridge * ahead
        new = ahead - step * gradient
        ahead = new + k / (k + 3) * (new - w)
        w = new
    plain = w[:-1] / spread
    return np.append(plain, w[-1] - (plain * mean).sum())


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", x, w[:-1].astype(x.dtype)).astype(float) + w[-1]


def calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and intercept, with his smoothed targets, by Newton steps."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        r, h = p - target, np.maximum(p * (1 - p), 1e-6)
        g1, g0, h11, h10, h00 = (r * z).sum() + 1e-3 * (a - 1), r.sum() + 1e-3 * b, (h * z * z).sum() + 1e-3, (h * z).sum(), h.sum() + 1e-3
        det = h11 * h00 - h10 * h10
        da, db = (h00 * g1 - h10 * g0) / det, (h11 * g0 - h10 * g1) / det
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    return max(a, 1e-3), b


def logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def combined(odds: list[np.ndarray], prior: float) -> np.ndarray:
    """Log odds of two views that are independent within a class: both hold the prior, which counts once."""
    return odds[0] + odds[1] - prior


def cotrain(views: list[np.ndarray], label: np.ndarray, certain, rounds: int = ROUNDS, growth: float = GROWTH) -> tuple | None:
    """([(weights, slope, intercept) of each view], prior log odds, threshold) of labelled rows (label 1 or 0).

    certain(weights, taken, n_good, n_bad) gives for each view (good, ids, both views) of the unlabelled rows it is most
    certain of; they join the other view's rows. None without labels of both classes."""
    aside = np.arange(0, len(label), 4)
    train = np.setdiff1d(np.arange(len(label)), aside)
    if len(set(label[train])) < 2 or len(set(label[aside])) < 2:
        train = aside = np.arange(len(label))
        if len(set(label)) < 2:
            return None
    rows = [[v[train], label[train].astype(float)] for v in views]
    weights, taken = [logistic(*r) for r in rows], [[], []]
    most, share = growth * len(train), label[train].mean()
    for _ in range(rounds):
        for k, (good, ids, found) in enumerate(certain(weights, taken, max(1, int(most * share)), max(1, int(most * (1 - share))))):
            if len(good):
                taken[k] += list(ids)
                rows[1 - k] = [np.concatenate([rows[1 - k][0], found[1 - k]]), np.concatenate([rows[1 - k][1], good])]
        weights = [logistic(*r) for r in rows]
    fitted = [(w, *calibration(margin(v[aside], w), label[aside])) for v, w in zip(views, weights, strict=True)]
    prior = logit((label[aside].sum() + 0.5) / (len(aside) + 1))
    odds = combined([slope * margin(v[aside], w) + intercept for v, (w, slope, intercept) in zip(views, fitted, strict=True)], prior)
    good = np.sort(1 / (1 + np.exp(-np.clip(odds[label[aside] > 0], -500, 500))))
    return fitted, prior, float(min(0.5, good[int((1 - KEPT) * len(good))]))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED):
    """The calibrated views, prior and threshold, sent to the workers; None without labels of both classes."""
    known = known_labels(labels)
    sample = sample_features(docs, known, labelled).sort_values("doc_id")
    model = None
    if len(sample):
        sampled = sample["doc_id"].tolist()  # what is labelled beyond the sample counts as unlabelled: no join with the texts

        def certain(weights, taken, n_good, n_bad):
            found = most_certain(rows_of(docs), weights, [sampled + x for x in taken], n_good, n_bad)
            for view in (0, 1):
                own = found[found["view"] == view]
                yield own["good"].to_numpy(float), own["doc_id"].tolist(), [np.array(own[c].tolist(), np.float32) for c in ("content", "metadata")]

        model = cotrain([np.array(sample[v].tolist(), np.float32) for v in ("content", "metadata")], sample["label"].to_numpy(int), certain)
    return docs.sparkSession.sparkContext.broadcast(model)


def scores(model, batch: pa.RecordBatch) -> np.ndarray:
    """(content, metadata, both) probabilities of being good, of every row of a batch of `ROW`."""
    out = np.full((3, len(batch)), 0.5)
    if model is not None:
        for a, *made in views_of(batch):
            odds = [slope * margin(x, w) + intercept for x, (w, slope, intercept) in zip(made, model[0], strict=True)]
            out[:, a : a + len(made[0])] = [1 / (1 + np.exp(-np.clip(x, -500, 500))) for x in (*odds, combined(odds, model[1]))]
    return out


def _threshold(model, least: float | None) -> float:
    return least if least is not None else model[2] if model else 0.5


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, least: float | None = None) -> DataFrame:
    """(doc_id, content_score, metadata_score, quality, kept) for every row of docs (doc_id, text, lang, source, n_chars); least: another threshold."""
    sent = fit(docs, labels, labelled)

    def score(batches):
        for batch in batches:
            p = scores(sent.value, batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p), pa.array(p[2] >= _threshold(sent.value, least))], ["doc_id", "content_score", "metadata_score", "quality", "kept"])

    small_batches(docs.sparkSession)
    return rows_of(docs).mapInArrow(score, "doc_id long, content_score double, metadata_score double, quality double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, least: float | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that `classify` keeps; nothing is shuffled."""
    sent, places = fit(docs, labels), [docs.columns.index(n) if n in docs.columns else None for n in NAMES]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def keep(batches):
        for batch in batches:
            columns = [pa.nulls(len(batch), t) if i is None else batch.column(i).cast(t) for i, t in zip(places, kinds, strict=True)]
            p = scores(sent.value, pa.RecordBatch.from_arrays(columns, NAMES))
            yield batch.filter(pa.array(p[2] >= _threshold(sent.value, least)))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
