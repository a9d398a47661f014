"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to 3. A symbol's code length is that of PPM with escape method C under
frozen counts: seen n times after a context of total T with D different successors it costs -log2 n / (T + D); unseen it
costs the escape -log2 D / (T + D) and then its cost in the next shorter context; contexts that a language never saw are
passed over; below order 0 all symbols are alike. The language of the least code length for the whole text wins, and the
score is its posterior under equal priors.

Bytes are folded first: ASCII and Latin-1 capitals to small letters, digits and white space to one symbol each, and all
bytes that training never saw to one symbol.

Training takes at most about `per_language` labelled documents a language, those of the smallest hashes, and every context
they have. A language's table has a row for each context that it saw, so the model grows with the contexts of the
languages, not with their product. Every document is predicted from its whole text.

Cases: null texts and texts without a letter are `und` with score 0, as is everything if nothing could be learned; ties
go to the language first by code point; equal texts get equal results; an empty table gives no rows; lang, source and
doc_id are no inputs of a prediction, and other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, small_batches, text_bytes

#: Training documents of a language, about.
PER_LANGUAGE = 2000
UNKNOWN = "und"


def _folding() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[48:58] = 48
    fold[9:14] = 32
    return fold


FOLD = _folding()


def folded(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = FOLD[data]
    if len(out) > 1:  # capitals of U+00C0 to U+00DE, but for the multiplication sign
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 32
    return out


def contexts(symbols: np.ndarray, offsets: np.ndarray, blank: int) -> list[np.ndarray]:
    """The symbols 1, 2 and 3 places before each one; before the beginning of a text stand blanks."""
    out = []
    starts = offsets[:-1][np.diff(offsets) > 0]
    for k in (1, 2, 3):
        c = np.empty_like(symbols)
        c[k:], c[:k] = symbols[:-k] if len(symbols) > k else symbols[:0], blank
        for j in range(k):
            at = starts + j
            c[at[at < len(c)]] = blank  # short texts: their followers' first places are blank anyway
        out.append(c)
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, text) of a bounded sample of the rows that may be learned from; the counts by language cover all rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = [(r["lang"], float(min(1.0, per_language / r["count"]))) for r in rows.groupBy("lang").count().collect()]  # a row a language
    if not counts:
        return rows.select("lang", "text").limit(0)
    share = F.element_at(F.create_map(*[F.lit(x) for pair in counts for x in pair]), F.col("lang"))
    return rows.where(F.pmod(F.xxhash64(F.lit(10), "doc_id"), F.lit(1 << 30)) < share * float(1 << 30)).select("lang", "text")


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): how often four folded bytes stand together; the last is the symbol, the first three its context."""

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                data, offsets = text_bytes(batch.column(1).filter(pa.array(langs == lang)))
                symbols = folded(data, offsets)
                c1, c2, c3 = (c.astype(np.int64) for c in contexts(symbols, offsets, 32))
                grams, n = np.unique(c3 << 24 | c2 << 16 | c1 << 8 | symbols.astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    small_batches(rows.sparkSession)
    return rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # byte -> symbol
    size: int  # number of symbols, with the one for bytes never seen
    places: np.ndarray  # context of three symbols -> its place among all languages' contexts, or the last place
    rows: list[np.ndarray]  # for each language: place -> row of its table
    low: list[np.ndarray]  # for each language: context of two symbols -> row of its table
    bits: list[np.ndarray]  # for each language (row, symbol): code length


def build(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """The frozen trees of all languages from counts of four-byte grams, each as a table of code lengths."""
    seen = np.unique(np.concatenate([(gram >> s) & 255 for s in (0, 8, 16, 24)] + [np.array([32])]))
    size, codes = len(seen) + 1, np.full(256, len(seen), np.int64)
    codes[seen] = np.arange(len(seen))
    third, second, first, last = (codes[(gram >> s) & 255] for s in (24, 16, 8, 0))
    three = (third * size + second) * size + first
    all_three = np.unique(three)
    places = np.full(size**3, len(all_three), np.int32)
    places[all_three] = np.arange(len(all_three))
    rows, low, bits = [], [], []
    for k in range(len(languages)):
        own = lang == k
        keys, weight = last[own], n[own].astype(float)

        def after(which: np.ndarray, shorter: np.ndarray, keys=keys, weight=weight) -> np.ndarray:
            """Probabilities after each context: its counts, else the escape and the shorter context's."""
            counts = np.bincount(which * size + keys, weight, len(shorter) * size).reshape(-1, size)
            total, different = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            whole = np.maximum(total + different, 1)
            return np.where(total == 0, shorter, np.where(counts > 0, counts / whole, different / whole * shorter))

        p0 = after(np.zeros(len(keys), int), np.full((1, size), 1 / size))
        p1 = after(first[own], p0[np.zeros(size, int)])
        keys2, which2 = np.unique(second[own] * size + first[own], return_inverse=True)
        p2 = after(which2, p1[keys2 % size])
        keys3, which3 = np.unique(three[own], return_inverse=True)
        row2 = np.tile(np.arange(size), size)  # of a pair never seen: the row of its last symbol
        row2[keys2] = size + np.arange(len(keys2))
        p3 = after(which3, np.concatenate([p1, p2])[row2[keys3 % size**2]])
        row3 = np.append(row2[all_three % size**2], 0)
        row3[places[keys3]] = size + len(keys2) + np.arange(len(keys3))
        rows.append(row3.astype(np.int32))
        low.append(row2.astype(np.int32))
        bits.append(-np.log2(np.concatenate([p1, p2, p3])).astype(np.float32))
    return Model(languages, codes, size, places, rows, low, bits)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(text, language): bits."""
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    if not len(data):
        return out
    symbols = model.codes[folded(data, offsets)]
    c1, c2, c3 = contexts(symbols, offsets, int(model.codes[32]))
    two = c2 * model.size + c1
    place = model.places[c3 * model.size**2 + two]
    new = np.flatnonzero(place == len(model.rows[0]) - 1)  # contexts that no language saw
    full = np.flatnonzero(np.diff(offsets) > 0)
    for k, (rows, low, bits) in enumerate(zip(model.rows, model.low, model.bits, strict=True)):
        at = rows[place]
        at[new] = low[two[new]]
        cost = bits.ravel()[at.astype(np.int64) * model.size + symbols]
        out[full, k] = np.add.reduceat(cost, offsets[:-1][full], dtype=np.float64)
    return out


LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


def has_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(LETTER[data])])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for k in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[k] = any(c.isalpha() for c in column[int(k)].as_py() or "")
    return out


_BUILT: dict[str, Model] = {}


class Predictor:
    """The frozen model's counts, sent to the workers; each builds the tables once."""

    def __init__(self, docs: DataFrame, per_language: int = PER_LANGUAGE):
        found = gram_counts(training_rows(docs, per_language)).toPandas().sort_values(["lang", "gram"])  # bounded by the training sample
        languages = sorted(set(found["lang"]))
        number = {x: k for k, x in enumerate(languages)}
        counts = (languages, found["lang"].map(number).to_numpy(np.int16), found["gram"].to_numpy(np.int64), found["n"].to_numpy(np.int64))
        self.key = uuid.uuid4().hex
        self.sent = docs.sparkSession.sparkContext.broadcast(counts)

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, bits) of every text."""
        n = len(texts)
        data, offsets = text_bytes(texts)
        answer, score, bits = [UNKNOWN] * n, np.zeros(n), np.zeros(n)
        if not self.sent.value[0]:
            return answer, score, bits
        if self.key not in _BUILT:
            _BUILT.clear()
            names, lang, gram, count = self.sent.value
            _BUILT[self.key] = build(names, lang.astype(np.int64), gram, count)
        model = _BUILT[self.key]
        known = has_letter(texts, data, offsets)
        for a, b in chunks(offsets, 1 << 19):
            lengths = code_lengths(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            best = lengths.argmin(1)
            least = lengths[np.arange(b - a), best]
            score[a:b] = 1 / np.exp2(-np.minimum(lengths - least[:, None], 1000.0)).sum(1)
            bits[a:b] = least
            for k in np.flatnonzero(known[a:b]):
                answer[a + k] = model.languages[best[k]]
        score[~known] = 0
        return answer, score, bits


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits) for every row of docs (doc_id, text, lang)."""
    predictor = Predictor(docs, per_language)

    def predict(batches):
        for batch in batches:
            answer, score, bits = predictor(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(answer), pa.array(score), pa.array(bits)], ["doc_id", "held_out", "lang_pred", "score", "bits"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, bits double")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language is known with at least this score; nothing is shuffled."""
    predictor, at = Predictor(docs), docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            answer, score, _ = predictor(batch.column(at))
            yield batch.filter(pa.array((score >= least) & (np.array(answer, dtype=object) != UNKNOWN)))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)
