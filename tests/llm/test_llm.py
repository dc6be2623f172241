"""Every operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, common, embeddings, jaccard, language, license, lines, mixing, repeats, tiff, toxicity
from quarry.llm.registry import tokenizer

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, id long, rows long, n long"


def sample():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 6)))
    common_line = "Under the MIT License, this line stands in very many places of the corpus, again and again and again."
    rows = []
    for i in range(120):
        text = " ".join(word() for _ in range(rng.randint(1, 120)))
        if i % 3 == 0:
            text = text + "\n" + common_line + "\n" + " ".join(word() for _ in range(20))
        rows.append((i, text, ("en", "fr", "es")[i % 3], f"s{i % 9}"))
    for i in range(120, 160):  # copies and near copies
        base = rows[i % 10][1].split(" ")
        if i % 2:
            base[rng.randrange(len(base))] = "Edited"
        rows.append((i, " ".join(base), "en", None if i % 7 == 0 else "s1"))
    rows += [(200, None, None, "s1"), (201, "", "en", "s2"), (202, "   \n\t", "en", None), (203, "ab" * 4000, "en", "s3"), (204, "x", None, "s4"), (205, "1 2 3", "en", "s4")]
    return [(*r, 1, 2, 3) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_repeats(rows, span=100):
    seen, out = set(), {}
    for key, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - span + 1):
            w = raw[p : p + span]
            if w in seen:
                gone[p : p + span] = b"\1" * span
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[key] = (len(raw), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("frequent", [2000, 3])
def test_repeats(docs, empty, monkeypatch, frequent):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)
    got = {r[0]: tuple(r[1:]) for r in repeats.remove_repeats(docs).collect()}
    assert got == brute_repeats([(r[0], r[1]) for r in sample()])
    assert any(v[1] for v in got.values())
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_of_equal_and_null_ids(spark):
    rows = [(1, "p" * 150), (1, "p" * 150), (None, "q" * 99 + "r" * 99), (5, "q" * 99 + "r" * 99)]
    got = sorted(map(tuple, repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed").collect()), key=str)
    assert got == sorted([(1, 150, 149), (1, 150, 149), (None, 198, 0), (5, 198, 198)], key=str)


def test_repeats_of_many_null_ids_equal_marks_and_long_texts(spark, monkeypatch):
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(50, 300)))
    rows = [(None, text() + passage[k % 300 : k % 300 + 150]) for k in range(2500)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 2500 and all(r["doc_id"] is None for r in got)
    # the first place of each byte string stays, whichever row counts as the first
    order = {r["n"]: r["doc"] for r in repeats.rows_of(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").select("doc", F.sha2("text", 256).alias("n")).collect()}
    want = brute_repeats([(order[hashlib.sha256(t.encode()).hexdigest()], t) for _, t in rows])
    assert sorted(tuple(r[1:]) for r in got) == sorted(want.values())
    # rows of one id whose texts have one mark, and a text beyond a piece
    rows = [(1, text() + passage[:400]) for _ in range(4)] + [(2, text() + passage * (repeats.PIECE // len(passage) + 5) + text()), (3, text() + passage)]
    marked = repeats.rows_of(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").withColumn("mark", F.lit(7))
    monkeypatch.setattr(repeats, "rows_of", lambda *_: marked)
    got = sorted(tuple(r) for r in repeats.remove_repeats(marked, keep_text=True).drop("kept").collect())
    first = sorted(rows[:4], key=lambda r: zlib.compress(r[1].encode(), 4))
    want = brute_repeats([(k - 10, t) for k, (_, t) in enumerate(first)] + rows[4:])
    assert got == sorted((1 if k < 0 else k, *v) for k, v in want.items())


def test_merge_is_a_sort():
    rng = random.Random(1)
    entries = [(bytes(rng.choice(b"ab") for _ in range(rng.randint(33, 60))), rng.randrange(3), (i, 0, i)) for i in range(500)]
    runs = [sorted(entries[k::7]) for k in range(7)]
    got = list(repeats.merge([repeats.Run.coded(r) for r in runs]))
    assert [g[1] for g in got] == sorted(e[0] for e in entries)
    assert all(g[0] == repeats.common_prefix(a[1], g[1], 0) for a, g in zip(got, got[1:]))


def brute_jaccard(rows, n, p, q):
    sets = {}
    for key, text in rows:
        w = words_of(text)
        k = min(n, len(w))
        sets[key] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize(("n", "p", "q"), [(4, 85, 100), (2, 60, 100)])
def test_jaccard(docs, empty, n, p, q):
    got = {r[0]: tuple(r[1:]) for r in jaccard.join(docs, words=n, threshold=(p, q)).collect()}
    assert got == brute_jaccard([(r[0], r[1]) for r in sample()], n, p, q)
    assert jaccard.join(empty).count() == 0


@pytest.mark.parametrize(("n", "p", "q"), [(4, 85, 100), (5, 80, 100)])
def test_jaccard_of_truncated_and_extended_copies(spark, n, p, q):
    rng = random.Random(21)
    rows = []
    for size in [20] * 60 + [40] * 20 + [100] * 15 + [300] * 8 + [1000] * 4:  # shingles of the longest copy that may still link, by the threshold
        words = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(size * q // p + n - 1)]
        rows += [(len(rows) + k, " ".join(words[: m + n - 1])) for k, m in enumerate((size, (size + size * q // p) // 2, size * q // p))]
    rng.shuffle(rows)
    got = {r[0]: tuple(r[1:]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=n, threshold=(p, q)).collect()}
    assert got == brute_jaccard(rows, n, p, q)
    assert len({v[1] for v in got.values()}) == len(rows) // 3


def brute_rows(rows, n, p, q):
    """Component by row where ids may be null or repeated: the smallest id among the rows that are connected."""
    found = brute_jaccard([(k, t) for k, (_, t) in enumerate(rows)], n, p, q)
    least = {}
    for k, (size, c) in found.items():
        if rows[k][0] is not None:
            least[c] = min(rows[k][0], least.get(c, rows[k][0]))
    return sorted(((rows[k][0], size, least.get(c)) for k, (size, c) in found.items()), key=str)


def test_jaccard_of_null_and_repeated_ids(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    chain = [" ".join(words[k : k + 44]) for k in (0, 2, 4)]  # the outer two link through the middle one only
    rows = [(7, chain[0]), (None, chain[1]), (3, chain[2]), (None, chain[1]), (9, "x y"), (9, "x y"), (9, chain[0]), (None, "alone in the world it is"), (None, "alone in the world it is"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in jaccard.join(docs).collect()), key=str)
    assert got == brute_rows(rows, 4, 85, 100)
    monkeypatch.setattr(jaccard, "TOLD", 1)
    assert sorted((tuple(r) for r in jaccard.join(docs).collect()), key=str) == got
    assert (3, 41, 3) in got and (7, 41, 3) in got


@pytest.mark.parametrize(("part", "edits"), [(4096, 0.02), (7, 0.02), (7, 0.06)])
def test_jaccard_of_large_groups_and_frequent_shingles(spark, monkeypatch, part, edits):
    """Groups of near copies of one page whose shingles pass the frequency bar, a long line that unrelated texts share, and lists beyond a part."""
    monkeypatch.setattr(jaccard, "PART", part)
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    pages = [[word() for _ in range(size)] for size in (40, 90)]
    rows = []
    for k in range(170):
        page = list(pages[k % 2])
        for _ in range(1 + int(len(page) * edits * rng.random() * 2)):
            page[rng.randrange(len(page))] = word()
        rows.append((k, " ".join(page[: len(page) - rng.randint(0, 3)])))
    line = [word() for _ in range(25)]
    rows += [(1000 + k, " ".join([*line, *(word() for _ in range(rng.randint(0, 12)))])) for k in range(120)]
    rng.shuffle(rows)
    got = {r[0]: tuple(r[1:]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_jaccard(rows, 4, 85, 100)


def test_blocks_and_derived_answers(monkeypatch):
    """Pairs of a list: none that links is lost by skipped blocks or bounds, and what counts as certain links."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = np.random.default_rng(6)
    for _ in range(30):
        hub = set(range(60))
        sets = [{x for x in hub if rng.random() > 0.04 * rng.integers(0, 5)} | {int(x) for x in rng.integers(60, 80, rng.integers(0, 8))} for _ in range(40)]
        sets.sort(key=len)
        p, q, threshold = 85, 100, (85, 100)
        ordered_ = [sorted(s, reverse=True) for s in sets]
        shared = [(k, o.index(50)) for k, o in enumerate(ordered_) if 50 in o]
        columns = np.array([[len(sets[k]), (len(sets[k]) * q - pos * (p + q)) // p, k, k, 99, 60, len(hub - sets[k]), len(sets[k] - hub), 0] for k, pos in shared], np.int64).T
        found = {(int(a), int(b)): bool(z) for x, y, w in jaccard.Entries(columns, threshold).pairs(0, 0) for a, b, z in zip(x, y, w)}
        links = {(a, b) for a, b in ((a, b) for i, (a, _) in enumerate(shared) for b, _ in shared[i + 1 :]) if q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b])}
        assert all(key in links for key, sure in found.items() if sure)
        first = {(a, b) for a, b in links if max(sets[a] & sets[b]) == 50}
        assert first <= set(found)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_tiff(docs, spark, empty):
    for compression in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS):
        for predictor in (1, 2):
            for tile in (None, 16):
                made = [np.random.default_rng(k).integers(0, 9, (37 + k, 50, 3)).astype(kind) for k, kind in enumerate((np.uint8, np.uint16))]
                for order in "<>":
                    back = tiff.read(tiff.write(made, compression, predictor, tile, rows=11, order=order))
                    assert all((a == b).all() for a, b in zip(made, back, strict=True))
    texts = {r[0]: (r[1] or "").encode() for r in sample()}
    for r in tiff.document_media(docs).collect():
        raw = texts[r["doc_id"]]
        raw_ = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(raw_), hashlib.sha256(raw_).hexdigest(), zlib.crc32(raw_[-64:]))
    file = tiff.write([np.zeros((4, 4, 1), np.uint8), np.ones((2, 2, 1), np.uint8)], tiff.LZW)
    files = spark.createDataFrame([(1, file), (2, None), (3, b"II*\0\xff\xff\xff\x0f"), (4, file[:-20])], "id long, content binary")
    got = {(r["id"], r["page"]): r["error"] for r in tiff.pages(files, "id", "content").collect()}
    assert got[1, 0] is None and got[1, 1] is None and got[2, None] and got[3, None] and any(k[0] == 4 for k in got)
    assert tiff.document_media(empty).count() == 0


def test_tiff_sizes_that_lie(spark):
    noise = np.random.default_rng(2).integers(0, 256, (40, 48, 1)).astype(np.uint8)
    for compression in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for tag, tile in ((tiff.WIDTH, None), (tiff.TILE_WIDTH, 16), (tiff.HEIGHT, 16)):
            file = bytearray(tiff.write([noise], compression, 1, tile))
            at = file.index(tiff.struct.pack("<HHI", tag, 4, 1)) + 8
            file[at : at + 4] = (1 << 30).to_bytes(4, "little")
            (row,) = tiff.pages(spark.createDataFrame([(1, bytes(file))], "id long, content binary"), "id", "content").collect()
            assert row["error"] and row["pixels"] is None
    flat = np.zeros((3000, 3000, 1), np.uint8)  # packs as well as anything can
    for compression in (tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        file = tiff.write([flat], compression, 1, None, rows=3000)
        assert (tiff.read(file)[0] == flat).all()
        with pytest.raises(tiff.Broken, match="large"):
            tiff.read(file, 1 << 20)


def test_tiff_of_long_texts(spark):
    long = "".join(random.Random(3).choice("abc é\n") for _ in range(2_600_000))
    rows = [(1, long, 1, 2), (None, long, 1, 2), (2, "a" * tiff.PAGE_BYTES, 1, 2), (2, None, 1, 2), (2, "\0" * 64, 1, 2), (3, "", 1, 2)]
    got = tiff.document_media(spark.createDataFrame(rows, "doc_id long, text string, page int, feature int").repartition(2)).collect()
    assert len(got) == len(rows)
    for key, text, _, _ in rows:
        raw = (text or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        media, n = tiff.store(text)
        samples = np.frombuffer(padded, np.uint8).astype(int)
        steps = np.abs(np.diff(samples.reshape(-1, 64), axis=1)).sum()
        feature = f"pages={-(-len(padded) // tiff.PAGE_BYTES)};rows={len(padded) // 64};mean={1000 * int(samples.sum()) // len(padded)};distinct={len(set(padded))};step={1000 * int(steps) // (len(padded) // 64 * 63)}"
        want = (key, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)
        assert want in [tuple(r) for r in got]


def test_toxicity(spark, docs, empty):
    data, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(data.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 0"), toxicity.CATEGORIES)
    rows = data.where("doc_id % 2 = 1").join(labels, "doc_id").select("text", "toxic").collect()
    hits = collections.Counter((chain.predict(r["text"])[1] > toxicity.LIMIT, r["toxic"] == 1) for r in rows)
    # about a tenth of the toxic labels of this table are noise: no word of these texts is particular to toxic ones
    assert hits[True, True] / (hits[True, True] + hits[False, True]) > 0.85
    assert hits[True, False] / (hits[True, False] + hits[False, False]) < 0.01
    assert chain.predict(None) == chain.predict("") == [0.0, 0.0]
    got = toxicity.score(docs, labels.limit(0), toxicity.CATEGORIES)
    assert got.count() == len(sample()) and got.where("p_toxic is null").count() == 0
    assert toxicity.score(empty, labels, toxicity.CATEGORIES).count() == 0


def test_toxicity_against_plain_sums(spark):
    """Probabilities of whole texts, word by word, from the fitted weights; and that the chain sees in training what models say that have not seen a row."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 7)))
    usual = [word() for _ in range(60)]
    rows = []
    for k in range(400):
        bad, low = k % 5 == 0, k % 3 == 0
        rows.append((k, " ".join([rng.choice(usual) for _ in range(30)] + ["Vile", "scum"] * bad + ["click", "here!"] * low), int(not low), int(bad)))
    texts = spark.createDataFrame([(k, t, 0.5) for k, t, _, _ in rows] + [(7, rows[7][1], 0.5), (None, "vile scum", 0.5), (900, "", 0.5), (901, None, 0.5), (902, "x " * 300_000 + "vile", 0.5)], "doc_id long, text string, p_toxic double").repartition(3)
    labels = spark.createDataFrame([(k, q, t) for k, _, q, t in rows] + [(5, 1, 1), (5, 1, 1), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(texts, labels, toxicity.CATEGORIES)

    def plain(text):
        found = []
        raw = (text or "").encode()
        buckets = set()
        for w in re.findall(rb"[A-Za-z\x80-\xff]+", raw):
            for k, n in enumerate((0, 4, 5)):
                buckets.add(int((toxicity.word_hashes(w, toxicity.LETTERS, n)[0] ^ np.uint64(k)) >> np.uint64(64 - toxicity.BITS)))
        for model in chain.models:
            z = model.b + sum(w for i, w in zip(model.ids.tolist(), model.weights.tolist()) if i in buckets) + sum(a * b for a, b in zip(model.v, found))
            found.append(1 / (1 + np.exp(-np.clip(z, -30, 30))) if text else 0.0)
        return found

    got = toxicity.score(texts, labels, toxicity.CATEGORIES, keep=("text",)).collect()
    assert len(got) == 405
    for r in got:
        assert np.allclose([r["p_low_quality"], r["p_toxic"]], plain(r["text"]), atol=1e-9)
    assert {r["doc_id"] for r in got if r["p_toxic"] > toxicity.LIMIT} >= {k for k in range(0, 400, 5)} | {None}
    sets = [toxicity.features(t) for _, t, _, _ in rows]
    marks = np.array([[1 - q, t] for _, _, q, t in rows])
    whole, fold = toxicity.Chain(sets, marks), np.arange(400) % toxicity.FOLDS
    extra = np.zeros((400, 1))
    for f in range(toxicity.FOLDS):
        part = toxicity.Linear([s for s, g in zip(sets, fold) if g != f], marks[fold != f, 0].astype(float), np.zeros((int((fold != f).sum()), 0)))
        for i in np.flatnonzero(fold == f):
            extra[i, 0] = part.predict(sets[i], np.zeros(0))
    assert np.allclose(toxicity.Linear(sets, marks[:, 1].astype(float), extra).v, whole.models[1].v)


def test_language(spark, docs, empty):
    data = spark.read.parquet(f"{SF}/documents.parquet".replace("0.001", "0.01"))
    got = language.identify(data).join(data.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() / got.count() > 0.95
    assert got.where("score < 0 or score > 1").count() == 0
    found = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert all(found[k]["lang_pred"] == "und" for k in (200, 201, 202, 205)) and found[204]["lang_pred"] != "und"
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in found.items())
    assert language.identify(empty).count() == 0
    odd = [(1, "\u00bd \u00b2 \u2167 \u2460 7_"), (2, "\u00aa"), (None, "Der Hund"), (None, "Der Hund"), (5, "\u4e2d")]
    found = language.identify(spark.createDataFrame([(*r, "de", 1) for r in odd], "doc_id long, text string, lang string, held_out int")).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in found) == [(0, "de"), (0, "de"), (1, "und"), (2, "de"), (5, "de")]


def test_language_pairs_vote():
    rng = np.random.default_rng(8)
    langs = np.array(["es", "fr", "it", "pt", "ru", "uk"])
    centers = rng.standard_normal((6, 12)) + 3 * (np.arange(6) >= 4)[:, None]
    y = rng.integers(0, 6, 600)
    x = (centers[y] + 0.3 * rng.standard_normal((600, 12))).astype(np.float32)
    model = language.Model(x, langs[y].tolist())
    assert len(model.languages["romance"][1]) == 6 and len(model.languages["slavic"][1]) == 1
    picked = [model.language(v, model.family(v)[0])[0] for v in x]
    assert np.mean(np.array(picked) == langs[y]) > 0.97


def test_mixing(docs, empty):
    rows = [(r[0], len(words_of(r[1])), r[3]) for r in sample()]
    sizes = collections.Counter()
    for _, n, s in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and weight[s] * level >= 3 * sizes[s]}
        if not over:
            break
        full |= over
    target = {s: 3 * sizes[s] if s in full else weight[s] * level for s in order}
    planned = mixing.plan(docs).collect()
    got = {r["doc_id"]: r for r in planned}
    for key, n, s in rows:
        r = got[key]
        assert (r["size"], r["source_size"]) == (n, sizes[s]) and abs(r["target"] - target[s]) < 1e-6 and r["taken"] <= 3 * n and (r["position"] is None) == (r["copies"] == 0)
    largest = collections.defaultdict(int)
    taken = collections.Counter()
    for key, n, s in rows:
        largest[s], taken[s] = max(largest[s], n), taken[s] + got[key]["taken"]
    assert all(abs(taken[s] - target[s]) <= largest[s] + 1 for s in order)
    assert {r["doc_id"]: r for r in mixing.plan(docs).collect()} == got
    assert mixing.plan(empty).count() == 0
    copies = mixing.schedule(mixing.plan(docs)).collect()
    places = [r["position"] for r in copies]
    assert places == sorted(places) and len(places) == sum(r["copies"] for r in planned) and 0 <= places[0] and places[-1] <= 1
    # by any time, each source has been taken to the integral of its weight, within one document
    rate = {s: mixing.DRIFT[k % 3] for k, s in enumerate(order)}
    for time in np.linspace(0, 1, 21):
        demand = {s: target[s] * time * (rate[s][0] + (rate[s][1] - rate[s][0]) * time / 2) for s in order}
        drawn = collections.Counter()
        for r in copies:
            drawn[r["source"]] += r["size"] * (r["time"] < time)
        assert all(abs(drawn[s] - demand[s]) <= largest[s] + 1 for s in order), time
        # and the positions up to then are the words of all sources
        upto = max((r["position"] for r in copies if r["time"] < time), default=0.0)
        assert upto <= sum(demand.values()) / total + 1e-9
    assert all(max(r["position"] for r in copies if r["source"] == s) > 1 - 2 * largest[s] / target[s] - 1e-9 for s in order if target[s] > 5 * largest[s])
    firsts = [r["position"] for r in mixing.ordered(mixing.plan(docs)).collect()]
    assert firsts == sorted(firsts, key=lambda p: (p is None, p or 0.0))


def test_mixing_of_null_and_repeated_rows(spark):
    rows = [(None, "a b c", "x"), (None, "a b c", "x"), (1, "d e", None), (1, "d e", None), (2, None, "x"), (3, "", None), (4, "f \x0b g\x85h", "y")]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == [0, 0, 2, 2, 2, 3, 3]
    assert sum(r["taken"] for r in got) >= 10 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.plan(spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")).agg(F.sum("taken")).first()[0] == 0


def brute_notices(w, k=license.K):
    """The labels and the score of a text's words, template by template."""
    labels, best = set(), 0.0
    for exact, phrase, label in [(True, *x) for x in license.BASE.items()] + [(False, *x) for x in license.NOTICES.items()]:
        parts = phrase.split()
        n = len(parts) - k + 1
        hits = [(p - a, a, p) for p in range(len(w) - k + 1) for a in range(n) if w[p : p + k] == parts[a : a + k]]
        bands = []
        for d in sorted({h[0] for h in hits}):
            if bands and d - bands[-1][-1] <= license.GAP:
                bands[-1].append(d)
            else:
                bands.append([d])
        for band in bands:
            share = max(sum(h[0] == d for h in hits) for d in band) / n
            if not exact:
                first, chain = {}, 0
                for d, a, p in hits:
                    if d in band:
                        first[a] = min(p, first.get(a, p))
                for a, p in sorted(first.items()):
                    chain += all(p > q for b, q in first.items() if b < a)
                share = chain / n
            best = max(best, share)
            if share >= (1 if exact else license.COVER):
                labels.add(label)
    return ",".join(sorted(labels)), best


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_license_notices_against_brute_force(spark, empty):
    rng = random.Random(17)
    phrases = [*license.BASE, *license.NOTICES]
    texts = []
    for i in range(300):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(phrases).split()
            for _ in range(rng.randint(0, 3)):  # drop, double, swap or put in words
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [w[k], w[k]], [w[k], "x"], [rng.choice(w)]])
            parts += w + ["filler"] * rng.randint(0, 3)
        texts.append(rng.choice([" ", "-", "  /", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in parts))
    texts += ["permission is hereby permission is hereby x x to any person", "", None, "é \0 ²", "word " * 200_000 + "under the MIT license", "\u212acc by nc"]
    rows = [(k, t, 1, 2) for k, t in enumerate(texts)] + [(None, texts[0], 1, 2)] * 2
    got = license.scan(spark.createDataFrame(rows, "doc_id long, text string, hash int, label int").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        w = license_words(texts[r["doc_id"] or 0])
        labels, score = brute_notices(w)
        assert (r["n_words"], r["labels"]) == (len(w), labels) and abs(r["score"] - score) < 1e-12, texts[r["doc_id"] or 0]
    assert license.scan(empty).count() == 0


def test_license_overlaps_and_notices(spark):
    rows = [(1, "CC BY-NC cc-by-nc BY NC"), (2, "This work is licensed under the GNU General Public License, version 3."), (2, "This work is licensed under the GNU General Public License, version 3."), (None, None)]
    got = sorted((tuple(r[c] for c in ("doc_id", "n_base", "base_labels", "labels")) for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 2, "cc-by-nc", "cc-by-nc"), (2, 0, "", "gpl-3"), (2, 0, "", "gpl-3"), (None, 0, "", "")], key=str)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((700, 16))
    base[200:260] = base[0] + 0.05 * rng.standard_normal((60, 16))
    base[260:270] = base[1]
    rows = [(i, [float(np.float32(v)) for v in x], i % 2 if i < 600 else 3) for i, x in enumerate(base)]
    rows += [(800, None, 1), (801, [0.0] * 16, 1), (802, [float("nan")] * 16, 1), (803, [1.0] * 16, None), (804, [], 1), (805, [1.0, 2.0], 1)]
    got = {r[0]: tuple(r[1:]) for r in embeddings.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows) and all(got[k] == (0, k, True) for k in range(800, 806))
    unit = base.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:700]])
    close = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(close, False)
    links = np.array([got[i][0] for i in range(700)])
    assert (links <= close.sum(1)).all() and links.sum() >= 0.98 * close.sum()


def brute_embeddings(rows, limit=0.93):
    """vec_id, links and component by all pairs; rows (id, vector, label) whose vectors are good and whose ids are unique."""
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([str(r[2]) for r in rows])
    close = (x @ x.T >= limit) & (label[:, None] == label)
    np.fill_diagonal(close, False)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(close)), strict=True):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return {r[0]: (int(close[i].sum()), least[find(i)]) for i, r in enumerate(rows)}


def clustered(rng, count, dimensions):
    """Vectors alone, in pairs around the bar, in chains and in dense groups, in shuffled order of ids."""
    base = rng.standard_normal((count, dimensions))
    for i in range(0, count // 2, 2):
        base[i + 1] = base[i] + rng.uniform(0.2, 0.45) * rng.standard_normal(dimensions)
    for i in range(count // 2, count // 2 + 60):
        base[i] = base[i - 1] + 0.2 * rng.standard_normal(dimensions)
    base[-700:] = base[-1] + 0.2 * rng.standard_normal((700, dimensions))
    ids = rng.permutation(count).tolist()
    return [(ids[i], [float(np.float32(v)) for v in x], "third" if i % 7 else "rest") for i, x in enumerate(base)]


@pytest.mark.parametrize("fit", [1 << 21, 64 * 500])
def test_embeddings_recall_where_nodes_split(spark, monkeypatch, fit):
    """Leaves hold 512 of 4000 vectors, so trees split, in a task (whole labels) and over levels (labels that don't fit)."""
    monkeypatch.setattr(embeddings, "FIT", fit)
    rows = clustered(np.random.default_rng(14), 4000, 64)
    got = {r[0]: tuple(r[1:]) for r in embeddings.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(5)).collect()}
    want = brute_embeddings(rows)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all(got[k][0] <= want[k][0] for k in want) and found >= 0.99 * there
    assert all(v[2] == (v[1] == k) for k, v in got.items())
    full = sum(got[k][1] == want[k][1] for k in want)
    assert full >= 0.99 * len(want)


def test_embeddings_components_are_exact_in_a_leaf(spark):
    rows = clustered(np.random.default_rng(3), 1000, 16)
    rows = [(k, v, f"{label}{k % 4}") for k, v, label in rows]
    got = {r[0]: (r[1], r[2]) for r in embeddings.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == brute_embeddings(rows)


def test_embeddings_of_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label string, id long, size int, data int"
    rows = [(7, [1.0, 0.0], "a"), (7, [1.0, 0.0], "a"), (3, [2.0, 0.0], "a"), (None, [1.0, 0.0], "a"), (9, [1.0, 0.0], "b"), (10, [1.0, None], "a"), (11, [1.0, 0.0, 0.0], "a"), (12, [float("inf"), 0.0], "a"), (13, [-0.0, 1.0], "a"), (14, [0.0, 1.0], "a")]
    got = sorted((tuple(r) for r in embeddings.near(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema)).collect()), key=str)
    assert got == sorted([(7, 2, 3, False), (7, 2, 3, False), (3, 2, 3, True), (None, 0, None, True), (9, 0, 9, True), (10, 0, 10, True), (11, 0, 11, True), (12, 0, 12, True), (13, 1, 13, True), (14, 1, 13, False)], key=str)
    assert embeddings.near(spark.createDataFrame([], schema)).count() == 0


def test_bpe(docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    own, theirs = bpe.codec(tokenizer()), Tokenizer.from_file(tokenizer())
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABC 0123456789'.,!?-_éßΣς中文İ́\x1c\x85\xa0​²Ⅷ½\n\tñ😀ﬁ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["".join(rng.choice("aeinrsthol") for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    texts += ["<|endoftext|> hi<|startoftext|>x", "it's we'll I'M", "", "a" * 3000, "hello</w> \0"]
    monkeypatch.setattr(bpe, "WORDS_KEPT", 300)  # tables fill, and what they held comes back
    for text in [*texts, *texts[:400]]:
        want = theirs.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert ids.tolist() == want
        assert own.decode(ids).decode() == theirs.decode(want, skip_special_tokens=False)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(docs, tokenizer()).collect()}
    for r in sample():
        ids = theirs.encode(r[1] or "", add_special_tokens=False).ids
        assert got[r[0]] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert bpe.encode_documents(empty, tokenizer()).count() == 0


def brute_lines(rows, sites=6, shortest=10, spare=0.0):
    trim = lambda line: line.replace("\t", " ").replace("\r", " ").strip(" ")
    found = collections.defaultdict(set)
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            found[trim(line)].add(site)
    gone = {line for line, on in found.items() if len(on) >= sites and len(line) >= shortest}
    out = []
    for key, text, _ in rows:
        kept = None if text is None else "\n".join(line for line in text.split("\n") if trim(line) not in gone)
        out.append((key, text if text is None or len(kept) < spare * len(text) else kept))
    return out


@pytest.mark.parametrize(("spare", "told"), [(0.0, 50_000), (0.5, 50_000), (0.0, 0)])
def test_lines(spark, empty, monkeypatch, spare, told):
    monkeypatch.setattr(lines, "TOLD", told)
    rng = random.Random(9)
    fill = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30))
    page = "\n".join(fill() for _ in range(4))
    rows = [(i, "\n".join([fill(), "Boilerplate of many sites", *(f"On {n} sites only, this one" for n in range(3, 12) if i < n), "\t Boilerplate of many sites \r", "short"]), f"s{i}") for i in range(12)]
    rows += [(100 + i, page + ("\n" + fill()) * (i % 2), f"s{i}") for i in range(12)] + [(300, None, "s1"), (301, "", None), (301, "", None), (None, page, None), (302, "Twice on a site\n" * 9, "s1")]
    rows += [(400 + i, "With the null site of five others\nx", f"s{i}" if i else None) for i in range(6)]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, n_lines int, hits int, row int").repartition(3)
    got = lines.strip_lines(frame, spare=spare).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(brute_lines(rows, spare=spare), key=str)
    assert all(r["n_lines"] == (0 if t is None else len(t.split("\n"))) for r in got for k, t, _ in rows if r["doc_id"] is not None and k == r["doc_id"])
    assert got[0]["hits"] == 2 and got[0]["row"] == 3
    assert lines.strip_lines(empty).count() == 0


def unrelated_and_copied():
    """Unrelated texts with a line and a footer of many sites; near copies of one page on many sites, which share a line; and the lines of many sites of unrelated texts."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    fill = lambda n: [" ".join(word() for _ in range(30)) for _ in range(n)]
    spread, footer, copied = "Read the news of many sites here", "All rights are with their owners", "A line of one page that has many near copies"
    page = fill(5)
    rows = [(i, "\n".join([*fill(4), spread, footer]), f"s{i % 12}") for i in range(48)]
    for i in range(100, 124):
        edited = [line.split(" ") for line in page]
        edited[i % 5][i % 30] = word()
        rows.append((i, "\n".join([*(" ".join(line) for line in edited), copied]), f"s{i % 12}"))
    return rows


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert set(after.columns) == set(docs.columns), name
        if name == "line_dedup":
            assert after.count() == docs.count()
        if name == "ngram_jaccard":
            want = brute_jaccard([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80, 100)
            assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted({v[1] for v in want.values()})
        docs = after
    assert P.run(spark, SF).count() == docs.count()


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as P

    rng = random.Random(31)
    rows = unrelated_and_copied()
    for size in [20] * 40 + [60] * 10 + [300] * 3:  # a text, and a longer copy at the threshold of 80/100 five-word shingles
        words = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(size * 5 // 4 + 4)]
        rows += [(1000 + len(rows) + k, " ".join(words[: m + 4]), "s1") for k, m in enumerate((size, size * 5 // 4))]
    docs = spark.createDataFrame([(key, text, "en", site, 0) for key, text, site in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stripped = P.boilerplate(spark, docs, SF).cache()
    want = dict(brute_lines(rows, spare=P.SPARE))
    assert {r["doc_id"]: r["text"] for r in stripped.collect()} == want
    kept = {v[1] for v in brute_jaccard(list(want.items()), 5, 80, 100).values()}
    assert sorted(r["doc_id"] for r in P.near_duplicates(spark, stripped, SF).collect()) == sorted(kept)


def test_pipeline_stages_on_nulls_and_repeats(spark):
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    page, other = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(1, page, "en", "a", 0), (1, page, "en", "a", 0), (None, page, "en", "b", 0), (None, other, "en", "b", 0), (None, other, "en", "b", 0), (1, other + " more", None, None, 0), (4, None, None, None, None), (4, None, None, None, None), (5, "", "en", "a", 0), (None, None, "de", "a", 0), (None, " ", "de", "a", 0)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, SF).collect()), key=str)
    assert kept == sorted([(1, page), (1, other + " more"), (4, None), (4, None), (5, ""), (None, None), (None, " ")], key=str)
    plan = mixing.plan(docs).collect()
    made = collections.Counter((r["doc_id"], r["text"]) for r in P.mixed(spark, docs, SF).collect())
    assert sum(made.values()) == sum(r["copies"] for r in plan)
    want = collections.Counter()
    for r in plan:
        want[r["doc_id"], r["size"]] += r["copies"]
    got = collections.Counter()
    for (key, text), n in made.items():
        got[key, len(words_of(text))] += n
    assert got == +want
    none = spark.createDataFrame([], schema)
    for name, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_pipeline_mix_order(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = [r["doc_id"] for r in mixing.schedule(mixing.plan(docs)).collect()]
    assert [r["doc_id"] for r in P.mixed(spark, docs, SF).collect()] == want
