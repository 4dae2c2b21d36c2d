"""Pipeline operators on small tables, against brute force."""

import collections
import math
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from atlas.llm import (common, components, decontaminate, jaccard, language_model, lines, neighbours, packing, quality,
                       tokens, toxicity, urls, wavelet)
from atlas.llm.queries import URL_RULES
from atlas.session import TEXT_BYTES

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id LONG, text STRING, lang STRING, size LONG, n LONG"


def docs(spark, rows):
    """Rows of id and text, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 1, 2) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, "Same text here, it's!"), (4, "Same text here, it's!"), (4, "Same text here, it's!"),
       (None, "no id at all"), (5, "word " * 5000), (6, " \n\t ")]


@pytest.mark.parametrize("rows", [ODD, []])
def test_packing(spark, rows):
    got = packing.pack(docs(spark, rows), TOKENIZER, size=64, open_windows=2).collect()
    known = collections.defaultdict(list)
    for i, text in rows:
        ids = np.append(tokens.encoder(TOKENIZER).encode([text])[0], 1)
        known[i].append(ids)
    assert sum(r["length"] for r in got) == sum(len(x) for v in known.values() for x in v)
    for r in got:
        ids = known[r.doc_id][0]
        part = ids[r.start:r.start + r["length"]].astype("<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32 and r.doc_tokens == len(ids)
    windows = collections.defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r["length"]))
    for pieces in windows.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
        assert end <= 64


@pytest.mark.parametrize("step", [
    lambda given: packing.pack(given, TOKENIZER).groupBy("doc_id").agg(F.sum("length")), lambda given: jaccard.join(given, 5, 80)])
def test_workers_are_handed_few_bytes(spark, tmp_path, monkeypatch, step):
    """Memory of a worker doesn't grow with the texts of a partition."""
    frames, real = type(spark.range(0)), type(spark.range(0)).mapInPandas

    def watched(self, function, *rest, **named):
        def through(parts):
            def noted():
                for part in parts:
                    held = sum(len(x) for name in part for x in part[name] if isinstance(x, (str, bytes)))
                    (tmp_path / uuid.uuid4().hex).write_text(str(held))
                    yield part
            return function(noted())
        return real(self, through, *rest, **named)

    monkeypatch.setattr(frames, "mapInPandas", watched)
    texts = F.concat(F.repeat(F.lit("word "), 100_000), F.col("id").cast("string"))
    given = spark.range(0, 24, 1, 1).select(F.col("id").alias("doc_id"), texts.alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert sorted(r.doc_id for r in step(given).collect()) == list(range(24))
    handed = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(handed) >= 12_000_000 and max(handed) <= TEXT_BYTES + 1_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_encoder_is_exact():
    encoder = tokens.encoder(TOKENIZER)
    texts = ["Don't stop!! it's ok...", "ÉTÉ ñandú ΣΑΣ. İ| x", "<|endoftext|> a", "a1b2 　 c\x85d", "tail,### $$$"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_wavelet_matrix():
    values = np.random.default_rng(1).integers(0, 300, 3000)
    matrix = wavelet.WaveletMatrix.build(values, 9)
    assert (matrix.values() == values).all()
    for at in (0, 7, 511, 512, 2999):
        assert matrix.access(at) == values[at]
    for value in (0, 17, 299, 511):
        places = np.flatnonzero(values == value)
        assert matrix.count(value) == len(places) and matrix.count(value, 1000) == (places < 1000).sum()
        for k in (0, len(places) - 1):
            assert matrix.find(value, k) == (places[k] if len(places) else -1)
        assert matrix.find(value, len(places)) == -1


@pytest.mark.parametrize("rows", [ODD, []])
def test_token_files(spark, rows):
    table = docs(spark, rows)
    folder = wavelet.new_folder(table)
    files = wavelet.write_tokens(table, folder, TOKENIZER, file_tokens=40, shard_bytes=100)
    if not rows:
        assert files.count() == 0
        return
    got = sorted(wavelet.read_tokens(files, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 4, 5, 6]
    start = 0
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        ids = np.append(tokens.encoder(TOKENIZER).encode([text])[0], 1)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), tokens.crc(ids))
        start += len(ids)


def test_lines(spark):
    block = "a line\nanother\nthird"
    rows = [(1, block + "\nown"), (2, "x\n" + block), (3, None), (4, ""), (5, "a line\nanother"), (6, "\n\n\n"), (7, "\n\n\n"),
            (8, block), (2, "x\n" + block), (9, "\n".join(["r"] * 5))]
    got = {r.doc_id: r for r in lines.cleaned(docs(spark, rows)).collect()}
    assert got[1].text == block + "\nown" and got[2].text == "x" and got[8].text == ""
    assert got[3].text is None and got[3].n_lines == 0 and got[4].text == "" and got[6].text == got[7].text == "\n\n\n"
    assert got[9].text == "" or got[9].n_removed == 4
    assert lines.cleaned(docs(spark, [])).count() == 0


def shingle_sets(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_jaccard(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, key = [], 0
    for group in range(12):
        base = [vocabulary[i] for i in rng.integers(0, 300, rng.integers(1, 160))]
        for _ in range(8):
            text = list(base)
            for _ in range(rng.integers(0, 5)):
                text[rng.integers(0, len(text))] = f"n{rng.integers(0, 10_000)}"
            rows.append((key, " ".join(text)))
            key += 1
    rows += [(key, None), (key + 1, ""), (key + 2, "two words"), (key + 3, "Two Words"), (None, rows[0][1])]
    for n, percent in ((3, 90), (5, 80)):
        sets = {i: shingle_sets(t, n) for i, t in rows if i is not None}
        parent = {i: i for i in sets}

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low, high = sorted((find(a), find(b)))
                    parent[high] = low
        got = {r.doc_id: r for r in jaccard.join(docs(spark, rows), n, percent).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items() if i is not None} == {
            i: (len(s), find(i)) for i, s in sets.items()}
        assert got[None].component_id is None
    assert jaccard.join(docs(spark, [])).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (3, 7), (7, 20), (20, 21)], "a LONG, b LONG")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 20: 1, 21: 1, 8: 8, 9: 8}


def test_leaks(spark):
    item = " ".join(f"item{i}" for i in range(30))
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, "tiny one")], "item_id LONG, text STRING")
    rows = [(1, "before " + item.upper() + ", after"), (2, item.replace("item29", "other")), (3, "clean words only"), (4, None),
            (5, ""), (6, " ".join(item.split()[:15]))]
    got = {r.doc_id: {m.item_id: round(m.similarity, 2) for m in r.leaks} for r in decontaminate.leaks(docs(spark, rows), items).collect()}
    assert got[1] == {1: 1.0} and got[2] == {1: 0.93} and got[3] == got[4] == got[5] == got[6] == {}
    assert [r.doc_id for r in decontaminate.clean(docs(spark, rows), items).collect()] == [3, 4, 5, 6]
    assert decontaminate.leaks(docs(spark, []), items).count() == 0
    passes = decontaminate.leaks(docs(spark, rows), items, pass_bytes=50)
    assert {r.doc_id for r in passes.where("size(leaks) > 0").collect()} == {1, 2}


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(400, 16)) * rng.uniform(0.5, 2, (400, 1))
    vectors[50:90] = vectors[3]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0]), (None, vectors[0].tolist())]
    table = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>")
    got = collections.defaultdict(list)
    for r in neighbours.search(table, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = []
    for q in range(0, 400, 20):
        scores = vectors @ vectors[q]
        best = [i for i in np.lexsort((np.arange(400), -scores.round(9))) if i != q][:20]
        hits.append(len(set(best) & {i for i, _ in got[q]}) / 20)
        assert all(abs(scores[i] - s) < 1e-9 for i, s in got[q])
    assert np.mean(hits) >= 0.9 and set(got) == set(range(0, 400, 20))
    assert neighbours.search(table.limit(0), lambda i: i % 20 == 0).count() == 0


def test_hilbert_visits_neighbours():
    grid = np.stack(np.meshgrid(range(8), range(8), indexing="ij"), -1).reshape(-1, 2)
    order = grid[np.argsort(neighbours.hilbert(grid, 3))]
    assert sorted(neighbours.hilbert(grid, 3)) == list(range(64))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_language_model(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.5, 60) if k < 5000)) for i in range(60)] + [(60, None), (61, "never seen words")]
    table = docs(spark, rows)
    for common in (5, 1000):
        got = {r.doc_id: r for r in language_model.score(table, F.col("doc_id") < 50, 1 << 18, common).collect()}
        split = {i: [*(t or "").split(), None] for i, t in rows}
        counts = collections.Counter(w for i, t in split.items() if i < 50 for w in t)
        total = sum(counts.values())
        for i, text in split.items():
            base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in text)
            assert got[i].base_score == pytest.approx(base) and got[i].train_tokens == total
            assert (got[i].n_tokens, got[i].n_known) == (len(text), sum(w in counts for w in text))
        assert all(r.score < 0 for r in got.values())
    assert language_model.score(table.limit(0), F.lit(True)).count() == 0


def test_filter_reads_levels_back():
    grams = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    levels = np.arange(2000) % 12 + 1
    bits = np.zeros(language_model.PIECE_BYTES, np.uint8)
    language_model.fill(bits, grams, levels, 1)
    model = language_model.Filter(bits, np.zeros(1), 1, 1, 0.1)
    read = model.level(grams)
    assert (read >= levels).all() and (read == levels).mean() > 0.97


def test_urls(spark):
    rows = [(1, "http://a.example.org/es/1"), (2, "https://EXAMPLE.org/en/15?x#y"), (3, "http://x.org"), (4, "http://x.org/"),
            (5, "ftp://b.com/fr/"), (6, "http://b.com/de/7"), (7, None), (8, "no scheme"), (9, "http://q.net/p?u=http://z.org/"), (10, "")]
    table = spark.createDataFrame(rows, "page_id LONG, url STRING")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(table, URL_RULES).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/15", "example.org/en/1", "block")
    assert got[3][:3] == ("x.org", "", None) and got[4][2:] == ("org/", "allow")
    assert got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block")
    assert got[7][:3] == got[8][:3] == got[10][:3] == ("", "", None) and got[9][:3] == ("q.net", "/p", None)
    assert {v[3] for v in got.values()} <= {"allow", "block"}
    assert urls.judge(table.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in urls.judge(table.where("page_id = 9"), URL_RULES).collect()} == {"allow"}


def test_markov_is_a_distribution():
    model = urls.Markov([b"abcabc", b"abd"], 3)
    for context in (b"", b"ab", b"zz", b"cab"):
        assert sum(math.exp(model.log_chance(context, c)) for c in range(257)) == pytest.approx(1)


def labelled(spark):
    rng = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(400):
        text = [f"t{int(k)}" for k in rng.integers(0, 200, 40)]
        bad = i % 5 == 0
        if bad:
            for at in rng.integers(0, 40, 4):
                text[at] = f"grobul{int(rng.integers(0, 9))}"
        rows.append((i, " ".join(text) if i % 7 else " ".join(w + "$$$" for w in text)))
        marks.append((i, int(bool(i % 7)), int(bad)))
    rows += [(1000, None), (1001, "")]
    return docs(spark, rows), spark.createDataFrame(marks + [(2000, None, None)], "doc_id LONG, quality INT, toxic INT"), marks


def test_toxicity_and_quality(spark):
    table, labels, marks = labelled(spark)
    rated = {r.doc_id: r for r in quality.score(toxicity.toxic(table, labels), quality.fit(table, labels)).collect()}
    assert len(rated) == 402 and all(0 <= r.toxicity <= 1 and 0 <= r.quality_score <= 1 for r in rated.values())
    assert np.mean([rated[i].is_toxic == bool(t) for i, _, t in marks]) > 0.95
    assert np.mean([(rated[i].quality_score >= 0.3) == bool(q) for i, q, _ in marks]) > 0.95
    assert not rated[1000].is_toxic and not rated[1001].is_toxic


def test_without_labels_nothing_is_rejected(spark):
    table, labels, _ = labelled(spark)
    none = labels.limit(0)
    assert toxicity.toxic(table, none).where("is_toxic").count() == 0
    assert quality.score(table, quality.fit(table, none)).where("quality_score < 0.3").count() == 0
    assert toxicity.toxic(table.limit(0), labels).count() == 0


def test_language_model_holds_all_pairs_in_groups_of_pieces(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.3, 400) if k < 100_000)) for i in range(150)] + [(150, None), (150, "w1 w2")]
    table = docs(spark, rows)
    model, _ = language_model.train(table, 1 << 16)
    pairs = model.part("pairs", 0, model.pair_pieces)
    counts = collections.Counter()
    for _, text in rows:
        codes = language_model.word_hashes([*(text or "").encode().split(), language_model.END])
        counts.update(language_model.gram(codes[:-1], codes[1:]).tolist())
    level = language_model.level_of(np.array(list(counts.values())))
    read = pairs.level(np.array(list(counts), np.uint64))
    assert (level == 1).sum() > 1000 and (read >= level).all() and (read == level).mean() > 0.95
    at_once = language_model.score(table, F.lit(True), 1 << 16)
    by_group = language_model.score(table, F.lit(True), 1 << 16, group_bytes=1 << 16)
    key = lambda r: (r.doc_id, r.n_tokens, r.score)
    for a, b in zip(sorted(at_once.collect(), key=key), sorted(by_group.collect(), key=key), strict=True):
        assert (a.doc_id, a.n_tokens, a.n_known) == (b.doc_id, b.n_tokens, b.n_known)
        assert a.score == pytest.approx(b.score) and a.base_score == pytest.approx(b.base_score)


def test_windows_cross_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(600, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    recall = []
    for rows in (600 * 8, 100):  # one block in all, and 48 blocks of fewer rows than a window
        monkeypatch.setattr(neighbours, "TASK_ROWS", rows)
        got = collections.defaultdict(set)
        for r in neighbours.search(table, lambda i: i % 20 == 0, curves=8).collect():
            got[r.query_id].add(r.vec_id)
        hits = [len(got[q] & {i for i in np.argsort(-vectors @ vectors[q])[:21].tolist() if i != q}) for q in range(0, 600, 20)]
        recall.append(np.mean(hits) / 20)
    assert recall[1] >= recall[0] > 0.5


def test_url_models_read_whole_urls(spark):
    rows = [(i, f"http://good.org/{i}?k=aaaa#top") for i in range(20)] + [(100 + i, f"http://b.com/de/{i}?k=zzzz#end") for i in range(20)]
    rows += [(200, "http://q.net/p?k=aaaa"), (201, "http://q.net/p?k=zzzz"), (202, "q.net/p?k=aaaa"), (203, "q.net/p?k=zzzz"),
             (204, "HTTP://q.net/p?k=AAAA"), (205, None)]
    rows += [(300, "http://good.org/" + "m" * 3000 + "?qwqwqw"), (301, "q.net/qwqwqw"), (302, "q.net/vjvjvj")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id LONG, url STRING"), URL_RULES).collect()}
    assert got[200].ratio > got[201].ratio and got[202].ratio > got[203].ratio and got[204].ratio == got[200].ratio
    assert got[301].ratio > got[302].ratio
    assert (got[202].host, got[202].path) == ("", "") and (got[204].host, got[204].path) == ("q.net", "/p")


def test_leaks_with_repeated_shingles():
    def bag(words):
        return collections.Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))

    items, texts = [], []
    for g in range(30):
        own = [f"u{g}n{i}" for i in range(89)]
        items.append((g, own + ["x"] * 15))
        texts.append(["before"] * 3 + own + ["x"] * 4 + [f"y{g}n{i}" for i in range(14)])  # 0.802
        plain = [f"p{g}n{i}" for i in range(104)]
        items.append((100 + g, plain))
        texts.append(plain[:94 - g % 4] + [f"z{g}n{i}" for i in range(20)])  # about 0.8
    index = decontaminate.Index([(i, " ".join(w)) for i, w in items], decontaminate.RADIUS, 0.8, 5)
    found = 0
    for text in texts:
        want = {}
        for i, words in items:
            b = bag(words)
            scores = []
            for at in range(len(text) - len(words) + 1):
                a = bag(text[at:at + len(words)])
                both = sum((a & b).values())
                scores.append(both / (sum(a.values()) + sum(b.values()) - both))
            if scores and max(scores) >= 0.8:
                want[i] = (scores.index(max(scores)), round(max(scores), 9))
        found += len(want)
        assert {m[0]: (m[1], round(m[3], 9)) for m in index.matches(" ".join(text))} == want
    assert found >= 45


def test_encoder_agrees_with_tokenizer_on_letters_and_marks():
    """Punctuation is cut off only after letters that normalizing keeps one letter each."""
    encoder = tokens.encoder(TOKENIZER)
    texts = [f"{c}. x{c}!" for c in map(chr, range(0x21, 0x3100)) if c.isprintable()]
    texts += ["क़. İ. aİ!", "É. Été... 12.5!", "A<|x|>. B́.", "a" * 50_000 + "?", "", None, " \x1c. "]
    for _ in range(2):  # the second time all pieces are known
        for text, ids in zip(texts, encoder.encode(texts)):
            assert ids.tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, text


def test_encoder_starts_anew_when_its_memory_is_full(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    encoder = tokens.Encoder(TOKENIZER)
    for text in ["one two three four five", "one", "six. seven!", "two three 4 5 6"]:
        assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_slices_of_batches_hold_the_same_words():
    import pyarrow as pa

    texts = [None if i % 11 == 3 else f" Über{i} x\x0b{'é' * (i % 7)}  end{i}." * (i % 4) for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = [language_model.text_of(part) for part in language_model.slices([batch], 300)]
    assert [len(part) for part in parts] == [300, 300, 300, 100]
    found = []
    for part in parts:
        named, codes, sizes = language_model.tokens(part)
        found += [[named[c] for c in x] for x in np.split(codes, np.cumsum(sizes)[:-1])]
    assert found == [[*common.words(text), language_model.END] for text in texts]
