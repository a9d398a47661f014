"""Co-training, and the pipeline's stages each on its own input, against plain versions."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from halocline.llm import cotraining, ppm_langid, source_schedule
from halocline.llm.common import staged
from halocline.llm.queries import BYTE_BPE, vocabulary
from halocline.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string"


@pytest.fixture(scope="module")
def stages(spark):
    """The input of every stage and the output of the last."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = staged(stage(spark, docs, SF), name)
    return seen | {"end": docs}


def component_names(texts):
    sets = {}
    for i, text in texts.items():
        words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(words)} if 0 < len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    name = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(name[a], name[b]), min(name[a], name[b])
                name = {i: new if x == old else x for i, x in name.items()}
    return name


def test_stages_keep_the_columns(stages):
    for name, _ in corpus_pipeline.STAGES[1:]:
        assert stages[name].columns == stages["language_id"].columns


def test_language_stage(stages):
    docs = stages["language_id"]
    known = {r.doc_id for r in ppm_langid.identify(docs).collect() if r.lang_pred != "und" and r.score >= 0.5}
    assert {r.doc_id for r in stages["quality_classifier"].collect()} == known


def test_quality_stage(spark, stages):
    docs = stages["quality_classifier"]
    kept = {r.doc_id for r in cotraining.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.kept}
    assert {r.doc_id for r in stages["near_copies"].collect()} == kept


def test_near_copy_stage(stages):
    texts = {r.doc_id: r.text for r in stages["near_copies"].select("doc_id", "text").collect()}
    assert sorted(r.doc_id for r in stages["source_mix"].collect()) == sorted(set(component_names(texts).values()))


def test_mix_stage(stages):
    taken = {r.doc_id: r for r in source_schedule.mix(stages["source_mix"]).collect()}
    times = Counter(r.doc_id for r in stages["pack"].collect())
    for i, r in taken.items():
        assert times[i] <= 2 and (not r["size"] or abs(times[i] - r.taken / r["size"]) <= 0.5)


def test_pack_stage(stages):
    coder, rows = Encoder(vocabulary(BYTE_BPE)), stages["end"].collect()
    docs = [(r.doc_id, np.append(np.frombuffer(coder.encode(r.text or ""), "<u4"), np.uint32(1)).astype("<u4")) for r in stages["pack"].collect()]
    ids = dict(docs)
    assert sum(r.length for r in rows) == sum(len(x) for _, x in docs)
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048


def test_cotraining_separates_what_both_views_show():
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 2, 400)
    views = [(rng.normal(size=(400, 4)) + truth[:, None]).astype(np.float32) for _ in range(2)]
    free = np.arange(80, 400)

    def certain(weights, taken, n_good, n_bad):
        for k in (0, 1):
            left = np.setdiff1d(free, taken[k])
            order = left[np.argsort(cotraining.margin(views[k][left], weights[k]), kind="stable")]
            ids = np.concatenate([order[:n_bad], order[-n_good:]])
            yield np.repeat([0.0, 1.0], [n_bad, n_good]), ids.tolist(), [v[ids] for v in views]

    fitted, prior, least = cotraining.cotrain([v[:80] for v in views], truth[:80], certain, rounds=4, growth=32 / 60)  # 32 rows a view and round
    odds = cotraining.combined([slope * cotraining.margin(x, w) + intercept for x, (w, slope, intercept) in zip(views, fitted, strict=True)], prior)
    assert ((odds > 0) == truth)[80:].mean() > 0.9 and 0 < least <= 0.5
    assert cotraining.cotrain([v[:80] for v in views], np.ones(80, int), certain) is None


def test_most_certain_equals_a_plain_search(spark):
    docs = cotraining.rows_of(spark.read.parquet(f"{SF}/documents.parquet").repartition(5))
    rng = np.random.default_rng(1)
    weights = [rng.normal(size=cotraining.TRIGRAMS + 12) * 9, rng.normal(size=cotraining.LANGS + cotraining.SOURCES + cotraining.SIZES + 1)]
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    plain = [{}, {}]
    for r in rows:
        body = np.frombuffer((r.text or "").encode(), np.uint8)
        made = cotraining.content_view(body, np.array([0, len(body)])), cotraining.metadata_view([r.lang], [r.source], [r.n_chars])
        for k in (0, 1):
            plain[k][r.doc_id] = float(cotraining.margin(made[k], weights[k])[0])
    skip = [r.doc_id for r in rows[:10]]
    found = cotraining.most_certain(docs, weights, [skip, []], 7, 4)
    for view in (0, 1):
        for good, most in ((1, 7), (0, 4)):
            z = {i: (x if good else -x) for i, x in plain[view].items() if not (view == 0 and i in skip)}
            best = [i for i, x in sorted(z.items(), key=lambda y: (-round(y[1], 4), y[0])) if x > 0][:most]
            got = found[(found["view"] == view) & (found["good"] == good)]["doc_id"].tolist()
            assert sorted(round(z[i], 3) for i in got) == sorted(round(z[i], 3) for i in best)


def test_the_metadata_view_reads_no_text():
    assert "text" not in cotraining.metadata_view.__code__.co_varnames
    a, b = cotraining.metadata_view(["en", None], ["s", "t"], [5, None])
    assert a.sum() == b.sum() == 3 and (a != b).any()


def test_cotraining_odd_inputs(spark):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, None), (3, "w " * 200000, None, "s", 1, "x"), (4, "ü 日本", "de", None, 1, "x"), (4, "ü 日本", "de", None, 1, "x"), (None, "text", "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = cotraining.classify(docs, none).collect()
    assert len(found) == len(rows) and all(r.quality == 0.5 and r.kept for r in found)
    some = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    found = cotraining.classify(docs, some).collect()
    assert len(found) == len(rows) and len({r.quality for r in found if r.doc_id == 4}) == 1
    assert cotraining.keep_good(docs, none).columns == docs.columns
    assert cotraining.classify(docs.drop("n_chars"), some).count() == len(rows)
    assert cotraining.classify(docs.limit(0), some).count() == 0


def test_cotraining_on_held_out_labels(spark):
    """Fitted on the labels of documents of even id, held against those of odd id."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = cotraining.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    good, bad = found.where(labels.quality == 1), found.where(labels.quality == 0)
    assert good.selectExpr("avg(cast(kept as double))").first()[0] > 0.95
    assert bad.selectExpr("avg(cast(kept as double))").first()[0] < 0.6


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None)], [(1, None, "en", None, 0, "x"), (1, None, "en", None, 0, "x"), (2, "", None, "s", None, None), (None, "one two", "en", "s", 7, None), (3, "wort " * 30000, "de", None, 9, "x")]])
def test_stages_on_odd_tables(spark, rows):
    """Nulls in every column, empty and long texts, repeated rows, no rows at all, an extra column."""
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() <= 2 * max(len(rows), 100) and (name == "pack" or out.columns == docs.columns)
