"""Deduplication, language, quality and the pipeline against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import minhash
from assayer.llm.components import connected_components
from assayer.llm.embed_dedup import SKETCH, SKETCH_MISS, embedding_near_dedup, sketch_reach, tables_for
from assayer.llm.langid import identify, infer, keep_identified, train
from assayer.llm.minhash import near_duplicates
from assayer.llm.quality_mil import score
from assayer.llm.quality_mil import train as fit_quality
from assayer.llm.substring import remove_repeats

from .brute import components, near, repeats


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(k, k + 1) for k in range(200, 260)]
    links = [ab for ab in links if ab[0] != ab[1]]
    want = components({x for ab in links for x in ab}, links)
    rows = connected_components(spark.createDataFrame([*links, (300, 300), (None, 5)], "a long, b long")).collect()
    assert dict(map(tuple, rows)) == want and len(rows) == len(want)


@pytest.mark.parametrize("block", [1024, 16])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr("assayer.llm.embed_dedup.BLOCK", block)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + rng.normal(size=16) * (0.03 if k % 3 else 0.6)).tolist(), k % 2) for k in range(160)]
    rows += [(200 + k, centres[0].tolist(), 0) for k in range(60)]
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0), (304, [None] + [1.0] * 15, 0), (305, centres[0].tolist(), None), (306, centres[0].tolist()[:8], 0), (307, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string").repartition(4)
    ok = {i: np.array(v, np.float32).astype(np.float64) for i, v, _ in rows[:220]}
    label = {i: k for i, _, k in rows}
    cos = lambda a, b: a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)
    links = [(a, b) for a in ok for b in ok if a < b and label[a] == label[b] and cos(ok[a], ok[b]) >= 0.98]
    part = components(label, links)
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_near_dedup(df).collect()}
    assert out == {i: (sum(i in ab for ab in links), part[i], part[i] == i) for i in label}
    assert embedding_near_dedup(df.limit(0)).count() == 0


def test_recall_holds_at_every_size():
    for n in (1, 10, 10**4, 10**7, 10**10):
        bits, tables = tables_for(n, 0.98)
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables <= 1e-6


@pytest.mark.parametrize("cosine", [0.8, 0.98, 1.0])
def test_sketches_let_similar_pairs_through(cosine):
    p, reach = np.arccos(cosine) / np.pi, sketch_reach(cosine)
    beyond = lambda most: sum(math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k) for k in range(most + 1, SKETCH + 1))
    assert beyond(reach) < SKETCH_MISS and (reach == 0 or beyond(reach - 1) >= SKETCH_MISS)


def _corpus(seed=4, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 4)))
    base = [[word() for _ in range(rng.randint(1, 90))] for _ in range(25)]
    texts = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w) if rng.random() < 0.8 else "\n".join(w).upper())
    return [*enumerate([*texts, None, "", " \t", "one", "ONE", "one two", "x" * 3000, "a b c d e"])]


@pytest.mark.parametrize("k,wide,block", [(4, 1024, 768), (5, 0, 7)])
def test_minhash(spark, monkeypatch, k, wide, block):
    monkeypatch.setattr("assayer.llm.minhash.WIDE", wide)
    monkeypatch.setattr("assayer.llm.minhash.BLOCK", block)
    docs = _corpus()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, n_shingles string").repartition(4)
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, shingle=k).collect()}
    assert out == near(docs, k)
    assert near_duplicates(df.limit(0)).count() == 0


def test_minhash_chain_is_not_lost(spark):
    """Neighbours in a chain of edits are similar, its ends are not: one component."""
    words = [f"w{k}" for k in range(200)]
    docs = []
    for k in range(40):
        words[(k * 5) % 200] = f"new{k}"
        docs.append((k, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, shingle=4).collect()}
    assert out == near(docs, 4)


@pytest.mark.parametrize("apart", ["symbols", "smallest hashes"])
def test_minhash_confirms_pairs_that_sketches_speak_against(spark, apart):
    """Similarity 0.8 exactly, under a shared key, whatever the rest of the sketch says."""
    words = [f"w{k}" for k in range(2000)]
    hashes = np.array([minhash.shingle_sets(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), 1)[0][0] for w in words])
    h = (hashes[:, None] ^ minhash._ODD[1]) * minhash._ODD[0]
    least = (h ^ (h >> np.uint64(32))).argsort(0)
    if apart == "symbols":
        # The first words of 20 of the 24 symbols are in one text alone; those of the others in both.
        own = list(dict.fromkeys(least[0, 4:].tolist()))
        shared = set(least[:1, :4].ravel().tolist())
        own = [k for k in own if k not in shared]
    else:
        shared = set(least[0].tolist())
        own = [k for k in hashes.argsort()[:220].tolist() if k not in shared]
    rest = [k for k in range(2000) if k not in shared and k not in set(own)]
    own = (own + rest)[:400]
    both = [k for k in range(2000) if k not in set(own)]
    halves = (own[0::2], own[1::2]) if apart != "symbols" else (own[:200], own[200:])
    docs = [(i, " ".join(words[k] for k in both + half)) for i, half in enumerate(halves)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, shingle=1).collect()}
    assert out == near(docs, 1) and out[1][1] == 0


@pytest.mark.parametrize("window", [35, 5])
def test_substrings(spark, window):
    rng = random.Random(window)
    base = [rng.choice("a b c d e ff gg".split()) for _ in range(300)]
    docs = []
    for i in range(80):
        w = []
        while len(w) < rng.randint(0, 200):
            r = rng.random()
            if r < 0.4:
                a = rng.randint(0, 290)
                w += base[a : a + rng.randint(1, 60)]
            elif r < 0.6:
                w += [rng.choice("xy")] * rng.randint(1, 90)
            else:
                w += [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 40))]
        docs.append((i % 60, " ".join(w)))
    docs += [(None, None), (500, ""), (501, " \n"), (None, " ".join(base)), (None, " ".join(base))]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, spans string").repartition(4)
    got = remove_repeats(df, window=window, words_only=True).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, repeats(docs, window)))
    texts = remove_repeats(df, window=window)
    assert set(df.columns) - {"spans"} <= set(texts.columns)
    for r in texts.collect():
        kept = " ".join((r.text or "").split())
        assert len(kept.split()) == r.n_words - r.n_removed
    assert remove_repeats(df.limit(0), window=window).count() == 0


def test_language(spark):
    rng = random.Random(6)
    kinds = {"aa": "na ta ka lo mi".split(), "bb": "ße üb sch ng ör".split(), "cc": "qu eau oi ç ez".split()}
    make = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(3)) for _ in range(n))
    rows = [(k, make(lang, 30), lang) for k, lang in enumerate(list(kinds) * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = train(df.where("doc_id < 45"))
    tests = [(k, make(lang, 25), lang) for k, lang in enumerate(list(kinds) * 5)] + [(90, None, None), (91, "123 !", None), (92, "", None)]
    tests.append((93, make("aa", 60) + " " + make("bb", 30), "aa"))
    out = {r.doc_id: r for r in identify(spark.createDataFrame([(*t, 1) for t in tests], "doc_id long, text string, x string, score int"), model).collect()}
    for k, _, lang in tests:
        assert out[k].lang_pred == (lang or "und") and 0 <= out[k].score <= 1
    assert out[93].score == pytest.approx(2 / 3, abs=0.05) and out[93].languages.startswith("aa:") and "bb:" in out[93].languages
    none = identify(df.limit(2), train(df.limit(0))).collect()
    assert [r.lang_pred for r in none] == ["und", "und"]
    assert identify(df.limit(0), model).count() == 0


def test_language_sets_have_no_cap():
    """Eight languages of 80 words each, which differ little, beside two that are not there."""
    words = np.full((640, 10), -3.0)
    words[np.arange(640), np.arange(640) % 8] = -1.0
    words[:, 8:] = -20.0
    share, _ = infer(words, np.zeros(640, np.int64))
    assert share[0] == pytest.approx([1 / 8] * 8 + [0, 0], abs=1e-3)


def test_language_mixtures_are_kept(spark):
    rng = random.Random(12)
    kinds = {"aa": "na ta ka lo mi".split(), "bb": "ße üb sch ng ör".split(), "cc": "qu eau oi ç ez".split()}
    make = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(3)) for _ in range(n))
    rows = [(k, make(lang, 30), lang) for k, lang in enumerate(list(kinds) * 20)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = " ".join(make(k, n) for k, n in (("aa", 45), ("bb", 35), ("cc", 20)))
    docs = spark.createDataFrame([(1, mixed), (2, "na üb eau"), (3, "12 !"), (4, None), (5, make("aa", 9))], "doc_id long, text string")
    assert max(r.score for r in identify(docs.where("doc_id = 1"), model).collect()) < 0.5
    assert {r.doc_id for r in keep_identified(docs, model).collect()} == {1, 2, 5}


def test_quality_classifier(spark):
    rng = random.Random(8)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "slowly", "home"]) for _ in range(150))
    bad = lambda: good()[:500] + " " + " ".join(rng.choice(["BUY!!", "$$$", "###", "click"]) for _ in range(60))
    rows = [(k, good() if k % 3 else bad()) for k in range(240)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(160)] + [(3, None), (None, 1)], "doc_id long, quality int")
    out = {r.doc_id: r for r in score(docs, fit_quality(docs, labels)).collect()}
    assert len(out) == 242 and all(0 <= r.score <= 1 for r in out.values())
    right = sum(out[k].predicted == int(k % 3 > 0) for k in range(160, 240))
    assert right >= 78
    flat = score(docs, fit_quality(docs, labels.limit(0))).collect()
    assert {r.score for r in flat} == {0.5}
    assert score(docs.limit(0), fit_quality(docs, labels)).count() == 0


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["the", "an", "er", "in", "st", "ou", "nd"]) for _ in range(3))
    passage = " ".join(word() for _ in range(60))
    docs = [(k, " ".join(word() for _ in range(rng.randint(60, 120)))) for k in range(40)]
    docs += [(50, docs[0][1]), (51, docs[1][1] + " more"), (52, docs[2][1] + "\n" + passage), (53, docs[3][1] + "\n" + passage)]
    docs += [(54, "123 456"), (55, None), (56, docs[4][1] + ' token = "abcdefghijkl0123"')]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)
    one = {r.doc_id: r for r in stage["language_id"](spark, df, str(tmp_path)).collect()}
    assert set(one) == {i for i, _ in docs} - {54, 55}
    kept = spark.createDataFrame(list(one.values()), df.schema)
    two = stage["minhash_near_dedup"](spark, kept, str(tmp_path))
    want = near([(i, r.text) for i, r in one.items()], 5)
    assert {r.doc_id for r in two.collect()} == {i for i, v in want.items() if v[2]} and two.columns == df.columns
    two = spark.createDataFrame(two.collect(), df.schema)
    three = {r.doc_id: r for r in stage["substring_dedup"](spark, two, str(tmp_path)).collect()}
    for i, n, gone, _ in repeats([(r.doc_id, r.text) for r in two.collect()], 35):
        assert len(three[i].text.split()) == n - gone and three[i].n_chars == len(three[i].text)
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in rows.collect()} == set(three)
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
