"""Pipeline operators on rows without ids, repeated ids, empty tables and columns with clashing names."""

import public_tokenizers

from atlas.llm import decontaminate, jaccard, lines, wavelet

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TEXT = " ".join(f"w{k}" for k in range(60))


def table(spark, rows):
    """Rows with columns that operators might call theirs."""
    return spark.createDataFrame([(i, t, 1, "a", "b", [1], "c", "d") for i, t in rows],
                                 "doc_id LONG, text STRING, _key INT, _gone STRING, _covered STRING, leaks ARRAY<INT>, _print STRING, least STRING")


def test_rows_without_an_id_pass_links_on(spark):
    rows = [(None, TEXT), (5, TEXT), (9, TEXT + " more"), (10, TEXT), (11, "other words here"), (None, "other words here")]
    got = {r.doc_id: r.component_id for r in jaccard.join(table(spark, rows)).collect()}
    assert got == {None: None, 5: 5, 9: 5, 10: 5, 11: 11}


def test_links_lead_through_texts_without_an_id(spark):
    words = TEXT.split()
    middle, end = " ".join([*words[:-1], "x"]), " ".join(["y", *words[1:-1], "x"])
    rows = [(5, TEXT), (None, middle), (9, end)]
    direct = {r.doc_id: r.component_id for r in jaccard.join(table(spark, [rows[0], rows[2]]), percent=94).collect()}
    linked = {r.doc_id: r.component_id for r in jaccard.join(table(spark, rows), percent=94).collect()}
    assert direct == {5: 5, 9: 9} and linked == {None: None, 5: 5, 9: 5}


def test_one_of_each_judges_rows(spark):
    clean = "a text of its own that nobody else has got anywhere at all"
    rows = [(1, TEXT), (2, TEXT + " more"), (2, clean), (3, None), (4, ""), (None, TEXT), (5, clean), (6, "twice told"), (6, "twice told"), (4, "")]
    kept = jaccard.one_of_each(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, TEXT), (2, clean), (3, None), (4, ""), (4, ""), (None, TEXT), (6, "twice told")], key=str)
    assert jaccard.one_of_each(table(spark, [])).count() == 0


def test_cells_follow_the_text():
    assert jaccard.cells_for(0) == jaccard.LEAST_CELLS and jaccard.cells_for(1 << 50) == jaccard.MOST_CELLS
    assert jaccard.LEAST_CELLS < jaccard.cells_for(1 << 29) < jaccard.MOST_CELLS


def test_lines_and_leaks_keep_clashing_columns(spark):
    block = "one line\ntwo line\nthree line"
    got = {r.doc_id: r for r in lines.cleaned(table(spark, [(1, block), (2, "x\n" + block)])).collect()}
    assert got[2].text == "x" and got[2]._key == 1 and got[2]._gone == "a" and got[2]._covered == "b"
    items = spark.createDataFrame([(7, TEXT)], "item_id LONG, text STRING")
    kept = decontaminate.clean(table(spark, [(1, TEXT), (2, "clean"), (3, None)]), items)
    assert sorted((r.doc_id, tuple(r.leaks)) for r in kept.collect()) == [(2, (1,)), (3, (1,))]
    assert decontaminate.clean(table(spark, [(1, TEXT)]), items.limit(0)).count() == 1


def test_no_token_files(spark):
    none = table(spark, [])
    folder = wavelet.new_folder(none)
    read = wavelet.read_tokens(wavelet.write_tokens(none, folder, TOKENIZER), folder)
    assert read.count() == 0 and read.columns == ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    some = table(spark, [(1, "a b")])
    folder = wavelet.new_folder(some)
    assert dict(wavelet.read_tokens(wavelet.write_tokens(some, folder, TOKENIZER), folder).dtypes) == dict(read.dtypes)


def test_fingerprints_propose_what_is_similar(spark, folder):
    """Whole tables through ``leaks``: fingerprints find what the exact bound finds, and decide it."""
    docs, items = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    docs = docs.repartition(8)

    def found(**options):
        rows = decontaminate.leaks(docs, items, **options).select("doc_id", "leaks").collect()
        return {(r.doc_id, m.item_id, m.start, round(m.similarity, 9)) for r in rows for m in r.leaks}

    assert found() == found(exact=True) != set()


def test_reach_grows_with_repeats():
    """An item that repeats a shingle, and a window that does, are compared further off."""
    import random
    draw = random.Random(1)
    items = {"plain": [f"a{k}" for k in range(104)], "repeats": [f"b{k}" for k in range(40)] + ["rep"] * 13 + [f"b{k}" for k in range(40, 92)]}
    index = decontaminate.Index(list(enumerate(" ".join(w) for w in items.values())), decontaminate.RADIUS, 0.8, 5)
    widest = {size: found[0] for size, found in index.sizes.items()}
    assert widest[105] > widest[104] > decontaminate.RADIUS
    exact = decontaminate.Index(list(enumerate(" ".join(w) for w in items.values())), decontaminate.RADIUS, 0.8, 5, True)
    seen = 0
    for k in range(200):
        words = list(list(items.values())[k % 2])
        at, n = draw.randint(0, 90), draw.randint(4, 8)
        words[at:at + n] = ["ha"] * n if k % 4 < 2 else [f"q{k}x{j}" for j in range(n)]
        text = " ".join(words)
        assert index.matches(text) == exact.matches(text)
        seen += bool(exact.matches(text))
    assert seen > 100
    # without fingerprints nothing is proposed
    index.prints = ~index.prints
    assert index.matches(" ".join(items["plain"])) == []
