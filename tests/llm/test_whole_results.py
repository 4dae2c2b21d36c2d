"""Models and the whole pipeline against independent versions in plain Python."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from atlas.llm import jaccard, language_model, quality, tokens, toxicity, urls
from atlas.llm.queries import TOKENIZER, URL_RULES

STEPS = sorted({*range(1, 5), *(math.floor(4 * 1.25 ** k) for k in range(1, 160))})


def step(count):
    """The largest step that is at most the count, and the one after it."""
    at = sum(s <= count for s in STEPS)
    return (STEPS[at - 1] if at else 0), STEPS[at]


def test_scores_of_the_language_model(spark):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"W{int(k)}" for k in rng.zipf(1.4, 120) if k < 400)) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "never seen"), (83, "w1 w1 never w1")]
    learned = [[*(t or "").lower().split(), None] for i, t in rows if i < 60]
    words = collections.Counter(w for t in learned for w in t)
    pairs = collections.Counter(p for t in learned for p in zip(t, t[1:]))
    total, distinct = sum(words.values()), len(words)
    seen, once = collections.Counter(), collections.Counter()
    for (context, _), n in pairs.items():
        seen[step(words[context])[0]] += n
        once[step(words[context])[0]] += n == 1

    def chance(context, word):
        single = (step(words[word])[0] + 0.5) / (total + 0.5 * (distinct + 1))
        if context is None or not words[context]:
            return single
        low, following = step(words[context])
        again = min(1 - once[low] / seen[low], 0.95)
        return again * min(step(pairs[context, word])[0] / (following if low > 4 else low), 1) + (1 - again) * single

    table = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = {r.doc_id: r.score for r in language_model.score(table, F.col("doc_id") < 60).collect()}
    for i, text in rows:
        own = [*(text or "").lower().split(), None]
        assert got[i] == pytest.approx(sum(math.log10(chance(*p)) for p in zip([None, *own], own))), i


def test_ratio_and_threshold_of_urls(spark):
    rng = np.random.default_rng(12)
    name = lambda letters: "".join(rng.choice(list(letters), int(rng.integers(1, 12))))
    rows = [(i, f"http://{name('abc')}.org/{name('abcd')}?{name('ab')}") for i in range(60)]
    rows += [(100 + i, f"HTTP://{name('cde')}.com/de/{name('bcdef')}") for i in range(60)]
    rows += [(200 + i, f"http://{name('abcdef')}.net/{name('abcdef')}é") for i in range(40)] + [(300, None), (301, "")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id LONG, url STRING"), URL_RULES).collect()}
    texts = {i: (u or "").lower().encode() for i, u in rows}

    def chance(examples, context, code):
        """Witten-Bell, from the longest context down to equal chances."""
        after = collections.Counter(c for t in examples for at, c in enumerate([*t, 256]) if t[:at].endswith(context))
        shorter = chance(examples, context[1:], code) if context else 1 / 257
        kinds, n = len(after), sum(after.values())
        return (after[code] + kinds * shorter) / (n + kinds) if n else shorter

    sides = [{texts[i] for i, r in got.items() if r.rule == rule} for rule in ("org/", "com/de/")]
    assert all(sides)
    for i in [0, 7, 100, 130, 200, 215, 230, 300, 301]:
        text = texts[i]
        logs = [sum(math.log(chance(side, text[max(0, at - 4):at], code)) for at, code in enumerate([*text, 256])) for side in sides]
        assert got[i].ratio == pytest.approx((logs[0] - logs[1]) / (len(text) + 1)), i

    good, bad = ([r.ratio for r in got.values() if r.rule == rule] for rule in ("org/", "com/de/"))
    error = lambda limit: np.mean([x < limit for x in good]) + np.mean([x >= limit for x in bad])
    judged = spark.createDataFrame([("allow", x) for x in good] + [("block", x) for x in bad], "by_rule STRING, ratio DOUBLE")
    limit = urls.threshold(judged)
    edges = np.arange(urls.BINS + 1) / urls.BINS * 20 - 10
    assert error(limit) == pytest.approx(min(map(error, edges)))
    assert all(r.verdict == ("allow" if r.ratio >= limit else "block") for r in got.values() if r.rule is None)


def test_threshold_of_quality_counts_all_labels(spark):
    rng = np.random.default_rng(13)
    rows = [(i, " ".join(f"t{int(k)}" + "$" * int(rng.integers(0, 4)) * (i % 3 == 0) for k in rng.integers(0, 99, 30))) for i in range(300)]
    marks = [(i, int(i % 3 > 0)) for i, _ in rows] + [(5, None), (6, 0), (6, 0), (999, 1)]
    table = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    labels = spark.createDataFrame(marks, "doc_id LONG, quality INT")
    model = quality.fit(table, labels, sample=60)
    trained = {(i, q) for i, q in marks if q is not None and i < 300 and zlib.crc32(str(i).encode()) % 5}
    rank = {i: float(model.rank(np.array([quality.features(t)]))[0]) for i, t in rows}
    ordered, bad = sorted(rank[i] for i, _ in trained), sum(q == 0 for _, q in trained)
    assert model.threshold == pytest.approx((ordered[bad - 1] + ordered[bad]) / 2, abs=4 * quality.SPAN / quality.BINS)
    by_pass = {r.doc_id: r.quality_score for r in quality.judge(table, labels).collect()}
    by_model = {r.doc_id: r.quality_score for r in quality.score(table, quality.fit(table, labels)).collect()}
    assert by_pass == pytest.approx(by_model) and len(by_pass) == 300
    assert quality.judge(table.limit(0), labels.limit(0)).count() == 0


def test_patterns_of_texts():
    text = "Hey YOU!! you, w*rd?! du $5 *bold* NO"
    found, total, persons = toxicity.hits(text, {}, set())
    assert (dict(found), total, persons) == ({}, 8, 3)
    assert toxicity.patterns(text, persons, total) == [2 / 8, 1 / 8, 1 / 8, 3 / 8]
    assert toxicity.patterns("", 0, 0) == [0, 0, 0, 0]


def test_label_model_learns_what_patterns_speak_for():
    rng = np.random.default_rng(15)
    toxic = rng.random(6000) < 0.3
    # three words of a lexicon that misses many toxic texts, counted by one voter that says clean without any
    words = (rng.random((6000, 3)) < np.where(toxic, 0.45, 0.01)[:, None]).astype(int)
    votes = np.column_stack([words, np.where(words.any(1), 1, -1)])
    telling = np.where(rng.random(6000) < np.where(toxic, 0.8, 0.1), 1, -1)
    reversed_, idle, rare = -telling, np.where(rng.random(6000) < 0.5, 1, -1), np.full(6000, -1)
    without = toxicity.label_model(votes)
    same = toxicity.label_model(votes, np.column_stack([rare]))
    assert np.abs(without - same).max() < 0.02
    for pattern in (telling, reversed_):
        got = toxicity.label_model(votes, np.column_stack([pattern, idle]))
        no_word = ~words.any(1)
        shown, hidden = got[no_word & (telling > 0)], got[no_word & (telling < 0)]
        assert shown.mean() > 2 * hidden.mean()
        assert np.mean((got > 0.5) == toxic) >= np.mean((without > 0.5) == toxic)
    apart = toxicity.label_model(votes, np.column_stack([idle]))
    assert abs(apart[idle > 0].mean() - apart[idle < 0].mean()) < 0.05


def without_repeated_lines(texts):
    """Texts by id without the lines of three-line windows that came before."""
    met, out = set(), {}
    for i, text in sorted(texts.items()):
        given = text.split("\n")
        gone = set()
        for at in range(len(given) - 2):
            window = tuple(given[at:at + 3])
            if any(x.strip() for x in window):
                gone |= {at, at + 1, at + 2} if window in met else set()
                met.add(window)
        out[i] = "\n".join(x for at, x in enumerate(given) if at not in gone)
    return out


def runs(words, n=5):
    return [tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []


def one_of_each(texts):
    """Texts by id; of those that links of similarity 0.8 lead to one another the one of least id."""
    sets = {i: set(runs(t.lower().split())) for i, t in texts.items()}
    group = {i: i for i in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return {i: t for i, t in texts.items() if group[i] == i}


def leaks(text, items):
    words = text.lower().split()
    for item in items:
        wanted = item.split()
        own = collections.Counter(runs(wanted))
        for at in range(max(1, len(words) - len(wanted) + 1)):
            window = collections.Counter(runs(words[at:at + len(wanted)]))
            if window and sum((window & own).values()) >= 0.8 * sum((window | own).values()):
                return True
    return False


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(14)
    words = lambda n: [f"t{int(k)}" for k in rng.integers(0, 900, n)]
    items = [" ".join(f"item{k}x{j}" for j in range(30)) for k in range(4)]
    block = "the first line\nthe second line\nthe third line"
    texts, marks = {}, []
    for i in range(400):
        own = words(40)
        toxic = i % 5 == 0
        if toxic:
            for at in rng.integers(0, 40, 6):
                own[at] = f"grobul{int(rng.integers(0, 4))}"
        elif i % 16 == 1:
            own = [*own[:10], *items[i % 4].split(), *own[10:]]
        elif i % 16 == 3 and i > 20:
            own = texts[i - 1].split() + ["more"] if (i - 1) % 5 else own
        texts[i] = " ".join(own[:20]) + ("\n" + block + "\n" if i % 16 == 6 else " ") + " ".join(own[20:])
        marks.append((i, 1, int(toxic)))
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in texts.items()] + [(1000, "", None, None, 0), (1001, None, "en", "web", None)],
                          "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id LONG, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id LONG, text STRING").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = without_repeated_lines({i: t for i, t in texts.items() if i % 5})
    assert sum(t != texts[i] for i, t in left.items()) > 10
    apart = one_of_each(left)
    clean = {i: t for i, t in apart.items() if not leaks(t, items)}
    assert len(texts) > len(left) > len(apart) > len(clean) > 200
    clean |= {1000: "", 1001: ""}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(clean)
    encode, pieces = tokens.encoder(TOKENIZER), collections.defaultdict(dict)
    for r in got:
        pieces[r.doc_id][r.start] = r
    for i, own in pieces.items():
        ids, at = np.append(encode.encode([clean[i]])[0], 1), 0
        for start, r in sorted(own.items()):
            assert start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[start:start + r["length"]].astype("<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "toxicity" and all(r.offset + r["length"] <= 2048 for r in got)


def test_prefixes_are_made_and_shuffled_once(spark, monkeypatch):
    made, wanted, entries = spark.sparkContext.accumulator(0), [], jaccard.entries

    def counted(distinct):
        rows = entries(distinct)
        wanted.append(rows.count())

        def count(frames):
            for frame in frames:
                made.add(len(frame))
                yield frame

        return rows.mapInPandas(count, rows.schema)

    monkeypatch.setattr(jaccard, "entries", counted)
    docs = [(k, " ".join(f"w{(k // 3 * 50 + i) % 97 if i != k % 3 else k}" for i in range(40))) for k in range(30)]
    found = jaccard.members(spark.createDataFrame(docs, "doc_id LONG, text STRING"), 3, 80)
    assert found.count() == 30 and made.value == wanted[0] > 0
