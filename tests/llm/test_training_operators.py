"""Training-data operators against plain versions, on small and odd inputs."""

import gzip
import hashlib
import re
import zlib

import numpy as np
import pytest

from tokenizers import Tokenizer

from halocline.llm import html_main_text, jpeg_media, ngram_join, orc_tokens, packing, ppm_langid, source_schedule, tokens, warc, weak_supervision
from halocline.llm.queries import BYTE_BPE, WORD_BPE, vocabulary
from halocline.llm.tokens import Encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [None, "", " \n\t", "one two", "One  TWO", BASE, BASE.upper(), BASE.replace("word30", "other"), BASE + " tail", "Ünï ß2³ don't we'll 's x\ty", "a  b \n c", "x " * 200, "Eins zwei drei. " * 30, "日本 語 <|endoftext|>", "é" * 700, BASE]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, ["en", "de", None][i % 3], [None, "s1", "s2", "s3"][i % 4], 0, "clash") for i, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_cached_ids_equal_the_librarys(name):
    coder = Encoder(vocabulary(name))
    for text in [t for t in TEXTS if t] + [" a", "a ", "a\n b", "a \nb", "a\r\n\r\n b\x1cc", "İx ΑΣ.　q", " \n"]:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_special_strings_are_the_librarys(name):
    plain, coder = Tokenizer.from_file(vocabulary(name)), Encoder(vocabulary(name))
    for text in ["<|endoftext|>", "a <|endoftext|> b", "a<|startoftext|>b <|ENDOFTEXT|>", "don't, stop. Ünï,", "x日本. q"]:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_the_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 50)
    coder = Encoder(vocabulary(BYTE_BPE))
    text = "a " + " ".join(f"w{i}" for i in range(400)) + " w3. w7, " + "long" * 40
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(coder.words) <= 50 and len(coder.words.old) <= 50


def test_packing_is_whole_and_gapless(docs, empty):
    coder = Encoder(vocabulary(BYTE_BPE))
    pieces, placed = packing.pack_documents(docs, vocabulary(BYTE_BPE), 128)
    rows = placed.collect()
    ids = {i: np.append(np.frombuffer(coder.encode(t), "<u4"), np.uint32(1)).astype("<u4") for i, t in enumerate(TEXTS)}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for sequence in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == sequence), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    assert packing.sequences(pieces, placed).selectExpr("sum(n_tokens)").first()[0] == sum(map(len, ids.values()))
    assert packing.pack_documents(empty, vocabulary(BYTE_BPE))[1].count() == 0


@pytest.mark.parametrize("length, most", [("9", 0.03), ("33", 0.04), ("5 + id % 60", 0.04), ("CASE WHEN id % 3 = 0 THEN 9 ELSE 1 + (id * 7919) % 2048 END", 0.04), ("128", 0.04)])
def test_short_pieces_are_padded_little(spark, length, most):
    pieces = spark.range(20_000).selectExpr("id AS piece", "id AS doc_id", "0L AS start", f"CAST({length} AS LONG) AS length", "'x' AS other")
    rows = sorted((r.sequence_id, r.offset, r.length, r.piece) for r in packing.place(pieces).collect())
    assert sorted(r[3] for r in rows) == list(range(20_000))
    filled = {}
    for sequence, offset, n, _ in rows:
        assert offset == filled.get(sequence, 0)
        filled[sequence] = offset + n
    assert max(filled.values()) <= 2048 and sum(filled.values()) >= (1 - most) * 2048 * len(filled)


def test_cutting_plan_covers_the_demand_near_its_bound():
    demand = np.bincount(np.random.default_rng(1).integers(1, 64, 5000), minlength=65)[1:]
    plan = packing.cutting_plan(demand)
    made = np.zeros(64, int)
    for lengths, times in plan:
        assert sum(lengths) <= 64
        for k in lengths:
            made[k - 1] += times
    assert (made == demand).all()
    assert sum(t for _, t in plan) <= 1.02 * (demand * np.arange(1, 65)).sum() / 64 + 2


def test_jaccard_components_equal_brute_force(docs, empty):
    sets = {}
    for i, text in enumerate(TEXTS):
        words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(words)} if 0 < len(words) < 5 else {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    name = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    name[a] = name[b] = min(name[a], name[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_documents(docs).collect()}
    assert got == {i: (len(sets[i]), name[i]) for i in sets}
    assert ngram_join.join_documents(empty).count() == 0


def test_jaccard_links_are_all_counted(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 6)
    monkeypatch.setattr(ngram_join, "COLUMNS", 32)
    base = [f"word{i}" for i in range(60)]
    copies = [base[:k] + ["other"] + base[k + 1 :] for k in range(0, 60, 3)]
    texts = [" ".join(w) for w in [*copies, *copies[:3], base[:30], [f"x{i}" for i in range(9)]]]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    links = {a: sum(a != b and 100 * len(x & y) >= 75 * len(x | y) for b, y in enumerate(sets)) for a, x in enumerate(sets)}
    assert max(links.values()) > 20 and sum(links.values()) > 2 * len(texts)
    found = ngram_join.join_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.n_links for r in found.collect()} == links


def brute_components(texts):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    name = list(range(len(sets)))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if 100 * len(x & y) >= 75 * len(x | y):
                name = [min(name[a], name[b]) if n in (name[a], name[b]) else n for n in name]
    return name


@pytest.mark.parametrize("rounds", [0, 1])
def test_jaccard_last_round_in_blocks(spark, monkeypatch, rounds):
    """Without the rounds that try one document of a token, the blocks alone find all components."""
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 6)
    monkeypatch.setattr(ngram_join, "TASK_ROWS", 50)
    monkeypatch.setattr(ngram_join, "COLUMNS", 32)
    rng = np.random.default_rng(rounds)
    base = [[f"b{g}w{i}" for i in range(50)] for g in range(4)]
    texts = []
    for k in range(60):  # near the similarity asked for, on both sides
        words = list(base[k % 4])
        for at in rng.choice(50, rng.integers(0, 4), replace=False):
            words[at] = f"new{rng.integers(0, 9)}"
        texts.append(" ".join(words))
    found = ngram_join.join_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.component_id for r in sorted(found.collect())] == brute_components(texts)


def test_jaccard_rows_without_id_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, BASE), (None, None), (3, BASE), (3, BASE), (5, BASE.upper()), (6, None)], "doc_id long, text string")
    rows = ngram_join.join_documents(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in rows if r.doc_id) == [(3, 56, 3, 1), (5, 56, 3, 1), (6, 0, 6, 0)]
    assert sorted((r.n_shingles, r.component_id, r.n_links) for r in rows if r.doc_id is None) == [(0, None, 0), (56, None, 0)]
    assert sorted(str(r.doc_id) for r in ngram_join.keep_one(docs).collect()) == ["3", "3", "6", "None", "None"]


def test_media_round_trip(docs, empty):
    rows = {r.doc_id: r for r in jpeg_media.digests(jpeg_media.store_media(docs)).collect()}
    for i, text in enumerate(TEXTS):
        body = (text or "").encode()
        payload = body + b"\xff" * (max(1, -(-len(body) // 576)) * 576 - len(body))
        assert (rows[i].n_bytes, rows[i].payload_bytes, rows[i].payload_sha256, rows[i].tail_crc32) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert rows[5].media_sha256 == rows[15].media_sha256 and rows[5].feature == rows[15].feature
    assert jpeg_media.store_media(empty).count() == 0


def test_media_of_several_shapes():
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0, 256, 576 * k).astype(np.uint8) for k in (1, 7, 700)]
    images = jpeg_media.decode_thumbnails(jpeg_media.encode_payloads(payloads))
    assert all((np.concatenate([x.ravel() for x in image]) == p).all() for image, p in zip(images, payloads, strict=True))


@pytest.mark.parametrize("units", [8191, 8192, 8209])
def test_media_of_payloads_over_an_image(units):
    payload = np.random.default_rng(units).integers(0, 256, 576 * units).astype(np.uint8)
    images = jpeg_media.decode_thumbnails(jpeg_media.encode_payloads([payload]))[0]
    assert len(images) == (1 if units <= 8191 else 2)
    assert (np.concatenate([x.ravel() for x in images]) == payload).all()


def plain_feature(payload):
    """The images cut from the payload, and each cell's mean against the next one's, by slices."""
    parts, found = [payload[a : a + 8191 * 576] for a in range(0, len(payload), 8191 * 576)], []
    for part in parts:
        wide = next(w for w in range(24, 577, 24) if len(part) % w == 0 and len(part) // w <= 8191)
        image = np.frombuffer(part, np.uint8).reshape(-1, wide)
        high, bits = len(image), ""
        for r in range(8):
            cells = [image[r * high // 8 : (r + 1) * high // 8, c * wide // 9 : (c + 1) * wide // 9] for c in range(9)]
            means = [cell.mean() if cell.size else 0.0 for cell in cells]
            bits += "".join(str(int(a > b)) for a, b in zip(means, means[1:]))
        found.append(f"{8 * wide}x{8 * high}x{len(parts)}:{int(bits, 2):016x}")
    return ";".join(found)


def test_media_feature_is_of_the_whole_text(spark):
    rng = np.random.default_rng(3)
    head, tails = "".join(map(chr, rng.integers(32, 127, 8191 * 576))), ["".join(map(chr, rng.integers(32, 127, 20 * 576))) for _ in range(2)]
    texts = ["", "short", head[:40000], head, head + tails[0], head + tails[1], head + tails[0][:-1] + "é", head + head + "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = {r.doc_id: r for r in jpeg_media.digests(jpeg_media.store_media(docs)).collect()}
    for k, text in enumerate(texts):
        body = text.encode()
        payload = body + b"\xff" * (max(1, -(-len(body) // 576)) * 576 - len(body))
        assert found[k].payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert found[k].feature == plain_feature(payload) and found[k].n_images == found[k].feature.count(":")
    assert found[4].feature != found[5].feature


PAGE = """<html><head><title>T</title></head><body><header class="site"><h1>Site</h1></header><div id="menu"><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div><div class="cookie-notice">We use cookies.</div>
<div class="content"><h2>Title</h2><p>Hello &lt;b&gt; w&ouml;rld &#39;x&#39;<br>next   line<p>Second <a href=z>link</a> paragraph, rather long.</p><div class=ad>Buy now</div><form><input><p>search</p></form><p>Third.</p></div>
<div id="comments"><article class="comment"><p>Nice post and a long comment by a reader.</p></article></div><footer>(c) me</footer></body></html>"""


def test_main_text():
    assert html_main_text.main_blocks(PAGE) == ["Title", "Hello <b> wörld 'x' next line", "Second link paragraph, rather long.", "Third."]
    assert html_main_text.main_text(None) == html_main_text.main_text("") == html_main_text.main_text("<script>x</script>") == ""
    assert html_main_text.main_blocks("<div class='ad'>x<article>y</article>") == ["y"]


def test_main_text_keeps_all_of_an_unmarked_page():
    story = [f"Paragraph {i} of the long text that this page is about." for i in range(30)]
    part, links = "".join(f"<p>{x}</p>" for x in story), "".join(f"<li><a href=x>See {i}</a></li>" for i in range(4))
    advert = "<div class=ad><p>Buy</p><p>this</p><p>now</p><p>please</p></div>"
    for between, kept in ((advert, []), (f"<ul>{links}</ul>", [f"See {i}" for i in range(4)])):
        page = f"<div class=menu><a href=y>Home</a></div><div class=story><h1><a href=z>Head</a></h1>{part}{between}<p>The end.</p><p><a href=w>All link</a></p></div>"
        assert html_main_text.main_blocks(page) == ["Head", *story, *kept, "The end.", "All link"]
    assert html_main_text.main_blocks(f"<div><a href=a>A</a></div><div><a href=b>B</a></div><div><a href=c>C</a></div><div class=story>{part}</div>") == story


def test_main_text_on_marked_pages():
    text = "".join(f"<p>Paragraph {i} of the long text that this page is about.</p>" for i in range(20))
    found = html_main_text.main_blocks(f"<div class=story>{text}</div><article><p>A teaser.</p></article>")
    assert found == [f"Paragraph {i} of the long text that this page is about." for i in range(20)] + ["A teaser."]
    article = "<article><h1><a href=x>Head</a></h1><p>Text of the article.</p><p><a href=y>All link</a></p></article>"
    assert html_main_text.main_blocks(f"<div>Tagline of the site</div>{article}<div>Imprint</div>") == ["Head", "Text of the article.", "All link"]


def test_main_text_drops_the_named_parts_only():
    page = "<article><p>One <math><mi>x</mi></math> two.</p><noscript><p>Shown.</p></noscript><p class='share-price'>The price of the share.</p><div class='related-work no-sidebar'>Work related to it.</div><div class='ad-box'>Buy.</div><div class='site-footer'>Me.</div></article>"
    assert html_main_text.main_blocks(page) == ["One x two.", "Shown.", "The price of the share.", "Work related to it."]
    assert html_main_text.main_blocks("<div><p>Before the picture.</p><div><svg><path></div><p>Behind an open picture.</p></div>") == ["Before the picture.", "Behind an open picture."]
    long = "Text &amp; more. " * 20000
    assert html_main_text.main_text(f"<article><p>{long}</p></article>") == html_main_text.html.unescape(long).strip()


def test_main_text_of_odd_tables(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>same text here</p>"), (2, "u", "<p>same text here</p>")]
    found = html_main_text.extract(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert sorted(str((r.page_id, r.text)) for r in found) == ["(1, '')", "(2, 'same text here')", "(2, 'same text here')", "(None, '')"]
    assert html_main_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_orc_digests(spark, docs, empty, tmp_path):
    coder, start = Encoder(vocabulary(WORD_BPE)), 0
    orc_tokens.write_orc(docs, f"file://{tmp_path}/a", vocabulary(WORD_BPE))
    stored = orc_tokens.read_orc(spark, f"file://{tmp_path}/a")
    rows = {r.doc_id: r for r in orc_tokens.digests(stored).collect()}
    for i, text in enumerate(TEXTS):
        ids = coder.encode(text) + b"\1\0\0\0"
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    orc_tokens.write_orc(empty, f"file://{tmp_path}/b", vocabulary(WORD_BPE))
    assert orc_tokens.digests(orc_tokens.read_orc(spark, f"file://{tmp_path}/b")).count() == 0
    assert "EqualTo(doc_id,3)" in stored.where("doc_id = 3")._jdf.queryExecution().toString()


def test_warc_revisits_and_salvage(spark):
    body = "<p>" + "x" * 200
    pages = spark.createDataFrame([(3, "u", body), (1, None, body), (2, "u", "short"), (4, "u", "short"), (5, "u", None)], "page_id long, url string, html string")
    rows = {r.headers["WARC-Record-ID"]: r for r in warc.archive(pages).collect()}
    assert not any(r.is_gap for r in rows.values()) and len(rows) == 5
    assert rows["<urn:page:3>"].headers["WARC-Refers-To"] == "<urn:page:1>" and rows["<urn:page:4>"].headers["WARC-Type"] == "response"
    members = [warc.gzip_member(warc.encode_record([("WARC-Type", "response"), ("n", str(k))], b"body %d" % k)) for k in range(4)]
    assert gzip.decompress(members[0]).startswith(b"WARC/1.0")
    damaged = members[0] + members[1][:20] + b"\0\0" + members[1][22:] + members[2] + warc.encode_record([("WARC-Type", "response"), ("n", "9")], b"plain") + b"junk" + members[3][:-9]
    found = list(warc.salvage(damaged))
    assert [h["n"] for _, _, h, _ in found if h] == ["0", "2", "9"]
    assert sum(end - start for start, end, _, _ in found) == len(damaged) and sum(h is None for _, _, h, _ in found) == 2


def test_salvage_reads_long_and_many_records():
    bodies = [bytes([k % 251]) * (3 * warc.SLICE) + str(k).encode() for k in range(5)] + [b"b%d" % k for k in range(2000)]
    data = b"".join(warc.gzip_member(warc.encode_record([("WARC-Type", "response")], b)) if k % 3 else warc.encode_record([("WARC-Type", "response")], b) for k, b in enumerate(bodies))
    found = list(warc.salvage(data))
    assert [x[3] for x in found] == bodies and found[-1][1] == len(data)


def test_warc_headers_and_empty_tables(spark):
    rows = warc.archive(spark.createDataFrame([(1, "u\r\nx", "body", 0), (1, "u\r\nx", "body", 0), (None, None, "é" * 200, 0)], "page_id long, url string, html string, start long")).collect()
    assert len(rows) == 3 and all(r.headers["WARC-Date"] == warc.DATE and not r.is_gap for r in rows)
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_measures(docs, empty):
    rows = {r.doc_id: r for r in weak_supervision.judge(docs).collect()}
    for i, text in enumerate(TEXTS):
        words = WORD.findall(text or "")
        seen, covered = {}, set()
        for k in range(len(words) - 7):
            seen.setdefault(tuple(words[k : k + 8]), []).append(k)
        for places in seen.values():
            if len(places) > 1:
                covered.update(j for k in places for j in range(k, k + 8))
        assert (rows[i].n_words, rows[i].word_chars, rows[i].n_repeat_words) == (len(words), sum(map(len, words)), len(covered))
        assert rows[i].base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
    assert weak_supervision.judge(empty).count() == 0


def test_mix_is_near_its_targets(spark, empty):
    docs = spark.createDataFrame([(i, "w " * (i % 50 + 1), [None, "a", "b", "c"][min(3, i % 7)]) for i in range(700)] + [(700, None, "a")], "doc_id long, text string, source string")
    rows = source_schedule.mix(docs).collect()
    assert len(rows) == 701 and all(r.taken <= 2 * r["size"] for r in rows)
    for source in (None, "a", "b", "c"):
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target
        assert sum(r["size"] for r in own) == own[0].source_size
    assert source_schedule.mix(empty).count() == 0


def test_language_held_out(spark, docs, empty):
    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = ppm_langid.identify(data).where("held_out").join(data.select("doc_id", "lang"), "doc_id")
    assert found.selectExpr("avg(cast(lang = lang_pred as double))").first()[0] > 0.95
    rows = {r.doc_id: r for r in ppm_langid.identify(docs).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (0, 1, 2))
    assert ppm_langid.identify(empty).count() == 0


def test_code_lengths_equal_a_plain_coder():
    """Every text's bits, by a tree of dictionaries."""
    texts = {"a": [b"the cat sat on the mat", b"then that hat"], "b": [b"der hund und die katze", b"und dann der hut"]}
    grams = {}
    for lang, some in texts.items():
        for t in some:
            padded = b"   " + t
            for k in range(len(t)):
                g = padded[k : k + 4]
                grams[lang, g] = grams.get((lang, g), 0) + 1
    keys = sorted(grams)
    model = ppm_langid.build(["a", "b"], np.array(["ab".index(l) for l, _ in keys]), np.array([int.from_bytes(g, "big") for _, g in keys]), np.array([grams[k] for k in keys]))
    alphabet = {c for _, g in keys for c in g} | {32}

    def chance(lang, context, symbol):
        if context is None:
            return 1 / (len(alphabet) + 1)
        counts = {}
        for (l, g), n in grams.items():
            if l == lang and (not context or g[3 - len(context) : 3] == context):
                counts[g[3]] = counts.get(g[3], 0) + n
        shorter = lambda: chance(lang, context[1:] if context else None, symbol)
        if not counts:
            return shorter()
        whole = sum(counts.values()) + len(counts)
        return counts[symbol] / whole if symbol in counts else len(counts) / whole * shorter()

    for text in (b"the hat", b"der hut", b"then und zq", b"a", b"mat hund thedie"):
        got = ppm_langid.code_lengths(model, np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
        for k, lang in enumerate("ab"):
            want = -sum(np.log2(chance(lang, (b"   " + text)[i : i + 3], text[i])) for i in range(len(text)))
            assert abs(got[k] - want) < 1e-3 * len(text)


def test_mix_targets_equal_a_plain_refill(spark):
    rng = np.random.default_rng(4)
    sizes = {f"s{k}": int(x) for k, x in enumerate(rng.integers(1, 5000, 11))} | {None: 700}
    rows = {r.source: r.target for r in source_schedule.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = sorted(n for n in sizes if n is not None) + [None]
    weight, total, fixed = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}, 1.5 * sum(sizes.values()), {}
    while True:
        left = (total - sum(fixed.values())) / max(1, sum(weight[n] for n in names if n not in fixed))
        over = [n for n in names if n not in fixed and left * weight[n] > 2 * sizes[n]]
        if not over:
            break
        fixed |= {n: 2.0 * sizes[n] for n in over}
    for n in names:
        assert abs(rows[n] - fixed.get(n, left * weight[n])) < 1e-6 * total
