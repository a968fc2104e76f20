"""Nulls, long texts, ties, repeated rows, empty tables, clashing names, and the sizes that work is done in."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from assayer.llm import langid, quality_mil, quality_rules, secret_scan
from assayer.llm.arrays import blocks_of, piece, running
from assayer.llm.chat_format import format_chats, parse_chats
from assayer.llm.minhash import first_of_groups, near_duplicates, placed_in_blocks
from assayer.llm.packing import cacheable, pack, text_encoder, token_pieces
from assayer.llm.secret_scan import redact, secret_spans
from assayer.llm.sentencepiece_codec import Codec
from assayer.llm.substring import remove_repeats
from assayer.llm.words import all_hashes, parts, word_hashes

from .brute import components, near, quality, repeats, secrets, sha, shingles
from .test_corpus_operators import _corpus

WORDS_FILE, PIECES_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("items,chars", [(256, 4096), (3, 4)])
def test_running_values_and_pieces(spark, monkeypatch, items, chars):
    monkeypatch.setattr("assayer.llm.arrays.ITEMS", items)
    monkeypatch.setattr("assayer.llm.arrays.CHARS", chars)
    rng = random.Random(1)
    rows = [(k, [rng.randint(-9, 9) for _ in range(n)], "".join(rng.choice("aé🙂\n") for _ in range(n))) for k, n in enumerate([0, 1, 2, 3, 4, 9, 10, 700])]
    df = spark.createDataFrame(rows, "k int, v array<bigint>, t string")
    cut = piece(blocks_of(F.col("t")), F.floor(F.length("t") / 3), F.length("t") - 1)
    out = df.select("k", running(F.col("v"), lambda a, b: a + b).alias("s"), running(F.col("v"), F.greatest).alias("m"), F.when(F.length("t") > 1, cut).alias("c")).collect()
    for r in out:
        _, v, t = rows[r.k]
        assert r.s == list(np.cumsum(v)) and r.m == list(np.maximum.accumulate(v) if v else [])
        assert len(t) < 2 or r.c == t[len(t) // 3 : len(t) - 1]


def test_parts_of_a_text(monkeypatch):
    monkeypatch.setattr("assayer.llm.words.PART", 7)
    rng = random.Random(2)
    for _ in range(200):
        raw = "".join(rng.choice("ab \n\té") for _ in range(rng.randint(0, 60))).encode()
        data = np.frombuffer(raw, np.uint8)
        cuts = list(parts(data))
        assert [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == len(raw)
        assert [w for a, b in cuts for w in raw[a:b].split()] == raw.split()
        for second in (False, True):
            whole = word_hashes(data, np.array([0, len(raw)]), True, second)[4 if second else 0]
            assert (all_hashes(data, True, second) == whole).all()


# Quality rules


def _kept(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, symbols, dup, repeat, failed = quality(text)
    value = {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": len(lines),
        "n_stop_words": sum(x.lower() in set(quality_rules.STOP_WORDS) for x in w), "n_shout_words": len(re.findall(r"[A-Z]{2,}[^\x20\x09-\x0D]*", text)),
        "n_bullet_lines": sum(bool(re.match(r"[\x20\x09]*[-*•]", x)) for x in lines), "n_ellipsis_lines": sum(bool(re.search(r"(\.\.\.|…)[\x20\x09]*$", x)) for x in lines),
    }
    ok = {}
    for r in quality_rules.RULES:
        scale = value[r.denominator] if r.denominator else 1
        ok[r.name] = (r.low is None or value[r.numerator] >= scale * r.low) and (r.high is None or value[r.numerator] <= scale * r.high)
    return ok, all(ok.values()) and not failed


def test_every_quality_rule_has_its_say(spark):
    base = [f"the river w{k} is" for k in range(12)]
    texts = [
        "\n".join(base), "too short", " ".join(f"the {'x' * 30}{k}" for k in range(30)), "\n".join(base) + " #$%&|<>*" * 8, "\n".join(base + base[:11]),
        " ".join(f"zz{k}" for k in range(40)), "\n".join(x.upper() for x in base), "\n".join("- " + x for x in base), "\n".join(x + "..." for x in base), " ".join("the a b c d e f g".split() * 6),
    ]
    texts += [texts[0], "\n".join(f"the river w{k} is" for k in range(40_000))]
    rows = quality_rules.quality_rules(spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, _words int")).collect()
    failing = set()
    assert len(rows) == len(texts)
    for r in rows:
        ok, kept = _kept(texts[r.doc_id])
        assert r.kept == kept, r.doc_id
        failing |= {name for name, v in ok.items() if not v}
    assert failing == {r.name for r in quality_rules.RULES} and rows[0].kept


# Packing


def test_packing_of_null_ids_repeated_rows_and_clashing_names(spark):
    texts = [None, "", "a b c", "a b c", "w " * 5000] + ["same text"] * 300
    df = spark.createDataFrame([(None if k % 2 else k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, piece string").repartition(4)
    pieces = token_pieces(df, WORDS_FILE).withColumns({"bucket": F.lit("b"), "rank": F.lit(7), "sequence_id": F.lit(1), "before": F.lit(2), "place": F.lit(3)})
    out = pack(pieces)
    assert out.columns == [c for c in pieces.columns if c != "sequence_id"] + ["sequence_id", "offset"]
    rows, places = out.collect(), collections.defaultdict(list)
    assert len(rows) == len(texts) + 1 and {(r.bucket, r["rank"], r.place) for r in rows} == {("b", 7, 3)}
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [a for a, _ in p] == [0, *np.cumsum([n for _, n in p])[:-1].tolist()]


def test_other_tokenizer_files_go_through_the_library(monkeypatch):
    from tokenizers import Tokenizer

    other = public_tokenizers.path("byte_bpe_50k.json")
    assert cacheable(WORDS_FILE) and not cacheable(other)
    text = "It's  a\nTest 123 é"
    assert np.frombuffer(text_encoder(other)(text), "<u4").tolist() == Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids
    monkeypatch.setattr("assayer.llm.packing.PART", 16)
    long = " ".join(["Some words, don't 42", "\x1f", "é" * 70, "x" * 100]) * 3
    for t in (long, long.replace("\x1f", "")):
        assert np.frombuffer(text_encoder(WORDS_FILE)(t), "<u4").tolist() == Tokenizer.from_file(WORDS_FILE).encode(t, add_special_tokens=False).ids


# Codec


def test_codec_on_long_texts(monkeypatch):
    import sentencepiece

    monkeypatch.setattr("assayer.llm.sentencepiece_codec.PART", 10)
    library, codec, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES_FILE), Codec(PIECES_FILE), random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["the", "  ", " ", "\n", "▁", "ing", "é", "x", "日", "0"]) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == [1, *library.encode(text), 2]
    long = "internationalisation" * 5000
    assert np.frombuffer(codec.encode(long), "<u4").tolist() == [1, *library.encode(long), 2]


# Secrets


def test_many_matches_and_long_texts(spark):
    rng = random.Random(4)
    value = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    parts_ = ["plain words é 🙂\n", "token=abcdefgh1234 ", "AKIA" + "ABCDEFGHIJKLMNOP ", "0123456789abcdef ", "id " + value() + "9a ", "secret: " + value() + " "]
    texts = ["".join(rng.choice(parts_) for _ in range(n)) for n in (0, 3, 500, 3000)]
    texts += [texts[2], "a " + "".join(value() for _ in range(60)) + "1a b", "z" * 6000 + " passwd=abcdefghijkl", None]
    df = spark.createDataFrame([(k, t, "x", 5) for k, t in enumerate(texts)], "doc_id long, text string, secrets string, __base int")
    found = secret_spans(df, out="spans")
    assert found.columns == [*df.columns, "spans"]
    rows = redact(found, spans="spans").collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        base = [s for s in r.spans if s["rank"] < 3]
        assert ",".join(f"{secret_scan.KINDS[s['rank']]}:{s['start']}:{s['end']}" for s in base) == secrets(t)
        want, at = [], 0
        for a, b in sorted((s["start"], s["end"]) for s in r.spans):
            if a >= at:
                want += [t[at:a], "[SECRET]"]
            at = max(at, b)
        assert (r.text or "") == "".join(want) + t[at:] and (r.secrets, r["__base"]) == ("x", 5)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].spans == by_id[4].spans and [s["rank"] for s in by_id[5].spans] == [3] and by_id[7].text is None


def test_entropy_of_long_values(spark, monkeypatch):
    monkeypatch.setattr("assayer.llm.secret_scan.STRETCH", 25)
    c, rng = secret_scan.CLASSES[1], random.Random(5)
    values = ["".join(rng.choice("abcXYZ019") for _ in range(n)) for n in (20, 25, 26, 44, 45, 50, 51, 300)]

    def want(v):
        return max(-sum(k / c.window * math.log2(k / c.window) for k in collections.Counter(v[i : i + c.window]).values()) for i in range(len(v) - c.window + 1))

    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", secret_scan.window_entropy(F.col("v"), c).alias("e")).collect()
    assert all(r.e == pytest.approx(want(r.v), abs=1e-9) for r in rows)


# Chats


def test_long_conversations(spark):
    rng = random.Random(6)
    rows = [(1, k, rng.choice(["user", "assistant", "assistant"]), rng.choice(["### x", "", "a </turn>\n", "é\\n"]) * rng.randint(0, 3)) for k in range(6000)]
    rows += [(2, k, "assistant", "same </part> text") for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for r in parse_chats(format_chats(df)).collect():
        want = [x[2:] for x in rows if x[0] == r.conv_id]
        assert [(x.role, x.text) for x in r.turns] == want
        assert r.loss_text == "".join(t for role, t in want if role == "assistant")


# Near duplicates


def near_rows(docs, k, percent=80):
    """Rows as documents of their ids: ids with a pair of similar rows, or with a row in common, are linked."""
    sets = [(i, shingles(t, k)) for i, t in docs if i is not None]
    links = [(a, b) for a, x in sets for b, y in sets if a < b and x and y and 100 * len(x & y) >= percent * len(x | y)]
    part = components({i for i, _ in sets}, links)
    out = [(i, len(x), part[i], part[i] == i) for i, x in sets]
    return out + [(None, len(shingles(t, k)), None, True) for i, t in docs if i is None]


def _hostile(rng):
    docs = [(i, t) for i, t in _corpus(seed=8, n=60)]
    docs += [(rng.randint(0, 40), t) for _, t in docs[:25]] + [(None, t) for _, t in docs[:5]] + docs[:6]
    words = [f"u{k}" for k in range(60)]
    docs += [(1, "p q r s t u v"), (1, " ".join(words)), (400, " ".join([*words[:-1], "other"])), (-5, " ".join(words[:-1]))]
    return docs


@pytest.mark.parametrize("limits", [{}, {"WIDE": 0, "MINOR": 0, "BLOCK": 7, "WEIGHT": 200, "PART": 64, "FEW": 3}])
def test_near_duplicates_of_shared_and_null_ids(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(f"assayer.llm.minhash.{name}", value)
    if limits:
        monkeypatch.setattr("assayer.llm.common.CHUNK", 100)
        monkeypatch.setattr("assayer.llm.words.PART", 64)
    docs = _hostile(random.Random(7))
    df = spark.createDataFrame([(*d, "x", {"m": 1}) for d in docs], "doc_id long, text string, row string, cid map<string,int>").repartition(4)
    got = [tuple(r) for r in near_duplicates(df, shingle=4).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, near_rows(docs, 4)))


def test_a_shared_id_keeps_the_links_of_all_its_texts(spark):
    words = [f"w{k}" for k in range(100)]
    df = spark.createDataFrame([(1, "a b c d e f"), (1, " ".join(words)), (2, " ".join([*words[:-1], "x"]))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df, shingle=4).collect()} == {(1, 1), (2, 1)}


def test_one_row_of_each_group_stays(spark):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [
        (1, words, {"a": 1}), (1, words, {"a": 1}), (1, words + " y", {"b": 2}), (1, "quite another text of seven words", None), (2, words.upper(), {"a": 3}), (3, None, None), (3, None, None),
        (4, "", None), (None, words, None), (None, words, None), (5, "quite another text of seven words", {"c": 1}), (0, "alone in the world it is", None), (0, "and a second text of this id", None),
    ]
    df = spark.createDataFrame([(*r, "i") for r in rows], "doc_id long, text string, row map<string,int>, id string").repartition(3)
    out = first_of_groups(df)
    assert out.schema == df.schema
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    one = [k for k in got if k[0] == 1 and k[1].startswith("w0")]
    assert len(one) == 1 and got.pop(one[0]) == 1
    want = [(1, "quite another text of seven words"), (3, None), (3, None), (4, ""), (None, words), (None, words), (0, "alone in the world it is"), (0, "and a second text of this id")]
    assert got == collections.Counter(want)
    assert first_of_groups(df.limit(0)).count() == 0


def _open(spark, total, minors, n):
    rows = [(1, k, n, 0 if k >= minors else -1 - k, 0) for k in range(total)]
    df = spark.createDataFrame(rows, "key long, cid long, n long, part long, major long")
    fixed = {"total": total, "weight": total * n, "minors": minors, "minor_weight": minors * n}
    return df.withColumns({k: F.lit(v) for k, v in fixed.items()})


def test_few_loose_classes_do_not_copy_a_large_key(spark, monkeypatch):
    assert placed_in_blocks(_open(spark, 8000, 5, 10)).count() == 8000 + 5 * math.ceil(8000 / 768)
    # Blocks are bounded by shingles too, and every minor class meets every class once.
    monkeypatch.setattr("assayer.llm.minhash.BLOCK", 20)
    monkeypatch.setattr("assayer.llm.minhash.WEIGHT", 100)
    rows = placed_in_blocks(_open(spark, 90, 30, 10)).collect()
    blocks = collections.defaultdict(lambda: ([], []))
    for r in rows:
        blocks[r.mb, r.ab][r.minor].append(r.cid)
    assert len(blocks) <= 3 * 9
    met = collections.Counter((m, o) for others, minors in blocks.values() for m in minors for o in others)
    assert met == {(m, o): 1 for m in range(30) for o in range(90)}


# Substrings


def test_substrings_of_long_texts(spark, monkeypatch):
    for name, value in {"words.PART": 300, "substring.PART": 300, "common.CHUNK": 200, "substring.BLOCK": 50, "substring.FEW": 2}.items():
        monkeypatch.setattr(f"assayer.llm.{name}", value)
    rng = random.Random(9)
    base = [rng.choice("a b c d e ff gg hhh".split()) + str(rng.randint(0, 9)) for _ in range(900)]
    docs = []
    for i in range(25):
        w = []
        for _ in range(rng.randint(0, 8)):
            a = rng.randint(0, 850)
            w += base[a : a + rng.randint(1, 120)] if rng.random() < 0.6 else [f"n{rng.randint(0, 10**6)}" for _ in range(60)]
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    docs += [(90, " ".join(base * 3)), (91, "x" * 2000 + " " + " ".join(base[:40])), (92, "y " * 900), (None, docs[0][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, k1 int").repartition(3)
    got = remove_repeats(df, window=35, words_only=True).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, repeats(docs, 35)))
    kept = remove_repeats(df, window=35)
    assert kept.columns == ["doc_id", "text", "k1", "n_words", "n_removed", "kept_sha256"]
    for r in kept.collect():
        assert hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest() == r.kept_sha256


# Language


def plain_em(words, share):
    for _ in range(20_000):
        joint = [[w * s for w, s in zip(row, share, strict=True)] for row in words]
        new = [sum(r[k] / sum(r) for r in joint) / len(words) for k in range(len(share))]
        done = max(abs(a - b) for a, b in zip(new, share, strict=True)) < 1e-9
        share = new
        if done:
            break
    return share, sum(math.log(sum(w * s for w, s in zip(row, share, strict=True))) for row in words)


def plain_mixture(logs):
    """Sets by size, in the order of the shares among all; (shares, value) of the highest penalised likelihood."""
    n, langs = len(logs), len(logs[0])
    single = [sum(row[k] for row in logs) for k in range(langs)]
    best, share = max(single), [float(k == single.index(max(single))) for k in range(langs)]
    words, price = [[math.exp(x) for x in row] for row in logs], 0.5 * math.log(n + 1)
    full, value = plain_em(words, [1 / langs] * langs)
    if value - price <= best:
        return share
    order = sorted(range(langs), key=lambda k: -full[k])
    for size in range(2, langs + 1):
        own, value = plain_em(words, [1 / size if k in order[:size] else 0.0 for k in range(langs)])
        if value - price * (size - 1) > best:
            best, share = value - price * (size - 1), own
    return share


def test_mixtures_against_plain_python():
    rng = random.Random(10)
    documents = []
    for _ in range(40):
        mix = [rng.randint(0, 4) for _ in range(rng.randint(1, 3))]
        documents.append([[-rng.random() - (0 if k == lang else rng.choice([1, 4])) for k in range(5)] for lang in (rng.choice(mix) for _ in range(rng.randint(1, 60)))])
    words = np.array([row for d in documents for row in d])
    doc = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    share, main = langid.infer(words, doc)
    different = 0
    for k, d in enumerate(documents):
        want = plain_mixture(d)
        assert share[k] == pytest.approx(want, abs=0.02)
        assert want[main[k]] >= max(want) - 0.02
        different += sum(x > 0.01 for x in want) > 1
    assert different > 5


def test_language_of_long_and_repeated_texts(spark, monkeypatch):
    rng = random.Random(11)
    kinds = {"aa": "na ta ka lo mi".split(), "bb": "ße üb sch ng ör".split()}
    make = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(3)) for _ in range(n))
    rows = [(k, make("ab"[k % 2] * 2, 40), "ab"[k % 2] * 2, "x") for k in range(40)] + [(None, make("aa", 9), None, "x")] * 2 + [(50, make("aa", 900) + " " + make("bb", 300), None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, has_letter string")
    whole = langid.train(df)
    out = langid.identify(df, whole).collect()
    for name, value in {"words.PART": 50, "langid.PART": 50, "common.CHUNK": 40}.items():
        monkeypatch.setattr(f"assayer.llm.{name}", value)
    cut = langid.train(df)
    assert cut[0] == whole[0] and (cut[1] == whole[1]).all()
    again = langid.identify(df, cut).collect()
    rounded = lambda rows: collections.Counter((r.doc_id, r.lang_pred, round(r.score, 9), r.languages) for r in rows)
    assert rounded(again) == rounded(out) and len(out) == 43
    again = {r.doc_id: r for r in again}
    assert again[50].lang_pred == "aa" and again[50].score == pytest.approx(0.75, abs=0.05)
    assert langid.keep_identified(df, cut).columns == df.columns


# Quality classifier


def plain_forward(m, bag):
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    hs = [np.tanh(((x - m["mean"]) / m["scale"]) @ m["w"] + m["b"]) for x in bag]
    logits = [float((np.tanh(h @ m["v"] + m["bv"]) * sigmoid(h @ m["u"] + m["bu"])) @ m["a"]) for h in hs]
    e = [math.exp(v - max(logits)) for v in logits]
    return float(sigmoid(sum(w / sum(e) * h for w, h in zip(e, hs, strict=True)) @ m["c"] + m["d"])[0]), int(np.argmax(e))


def test_attention_scores_against_plain_python(spark, monkeypatch):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abc XYZ019 é!?\n") for _ in range(n))
    rows = [(k, text(rng.choice([0, 5, 511, 512, 513, 3000]))) for k in range(60)] + [(None, None), (7, "twice"), (7, "twice"), (61, text(20_000))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    model = quality_mil.train(docs, labels)
    out = quality_mil.score(docs, model).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    for i, t in rows:
        raw = (t or "").encode()
        bag = [quality_mil._passages(np.frombuffer(raw[a : a + 512], np.uint8), np.array([0, len(raw[a : a + 512])]))[0][0] for a in range(0, max(1, len(raw)), 512)]
        p, top = plain_forward(model, bag)
        if i != 7:
            assert by_id[i].score == pytest.approx(p, abs=1e-4) and by_id[i].predicted == int(by_id[i].score >= 0.7) and by_id[i].top_passage == top
    for name, value in {"quality_mil.PART": 1024, "common.CHUNK": 100}.items():
        monkeypatch.setattr(f"assayer.llm.{name}", value)
    again = {r.doc_id: r.score for r in quality_mil.score(docs, model).collect()}
    assert all(again[i] == pytest.approx(by_id[i].score, abs=1e-5) for i, _ in rows)


def test_the_gradient_descends_on_every_passage(spark):
    """The label lies in one passage of a hundred, anywhere in the text."""
    rng = random.Random(13)
    plain = lambda: " ".join(rng.choice(["the", "river", "runs", "slowly", "home"]) for _ in range(100))[:512].ljust(512)
    bad = ("$$$ BUY!! ### " * 50)[:512]

    def text(k):
        bag = [plain() for _ in range(100)]
        if k % 2 == 0:
            bag[rng.randrange(100)] = bad
        return "".join(bag)

    docs = spark.createDataFrame([(k, text(k)) for k in range(120)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_mil.score(docs, quality_mil.train(docs, labels)).collect()}
    assert sum(out[k].predicted == k % 2 for k in range(80, 120)) >= 38


def test_the_bound_is_on_documents(spark, monkeypatch):
    monkeypatch.setattr("assayer.llm.quality_mil.PASSAGES", 40)
    docs = spark.createDataFrame([(k, ("a b " if k % 2 else "!! ") * (400 if k == 3 else 130)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr("assayer.llm.quality_mil.fit", lambda x, firsts, y: seen.append((len(x), len(y))) or {"share": np.float32(0.5)})
    quality_mil.train(docs, labels)
    assert seen[0][0] <= 40 and seen[0][1] > 20


# Pipeline


def test_pipeline_on_hostile_tables(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(14)
    make = lambda n: " ".join("".join(rng.choice(["the", "an", "er", "in", "st"]) for _ in range(3)) for _ in range(n))
    passage, secret = make(50), 'token = "abcdefghijkl0123"'
    rows = [(k, make(60)) for k in range(10)] + [(None, make(50)), (3, make(55)), (20, None), (21, ""), (22, make(40) + " " + passage), (23, passage + " " + make(40)), (24, make(30) + " " + secret)]
    rows.append(rows[0])
    schema = "doc_id long, text string, lang string, n_chars long, k1 map<string,int>, secrets string, row int"
    df = spark.createDataFrame([(i, t, "en", len(t or ""), {"a": 1}, "s", 2) for i, t in rows], schema).repartition(3)
    docs, kept = df, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), schema)
        assert stage(spark, before.limit(0), str(tmp_path)).count() == 0 and docs.columns == df.columns
        kept = [(r.doc_id, r.text) for r in before.collect()]
        now = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "language_id":
            assert sorted(map(repr, now)) == sorted(repr(r) for r in rows if r[1])
        elif name == "minhash_near_dedup":
            assert sorted(map(repr, now)) == sorted(repr(r) for r in rows[:-1] if r[1])
        elif name == "substring_dedup":
            want = {(i, n - gone) for i, n, gone, _ in repeats(kept, 35)}
            assert {(i, len(t.split())) for i, t in now} == want and passage not in " ".join(t for _, t in now)
        else:
            changed = {i: t for i, t in now if (i, t) not in kept}
            assert set(changed) == {24} and changed[24] == dict(kept)[24].replace(secret[:-1], "[SECRET]")
        assert all(r.n_chars == len(r.text) for r in docs.collect())
    out = corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS_FILE)
    want = collections.Counter((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in now)
    assert collections.Counter((r.doc_id, r.length) for r in out.collect()) == want
    assert out.select("sequence_id").distinct().count() == -(-sum(n for _, n in want.elements()) // 4096)
    assert corpus_pipeline.best_fit_packing(spark, docs.limit(0), str(tmp_path)).count() == 0


# SQL of the queries


def test_secret_scan_equals_its_sql(spark, tmp_path):
    import duckdb

    from assayer.llm.queries import op8_secret_scan, oracle_sql

    from .test_text_operators import SECRET_TEXTS

    rng = random.Random(15)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    value = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    parts_ = [" ", "\n", "é🙂", "=", "//", "AAAAAAA", "/usr/lib/share", "sample-", "-", "_", "token: ", "Api_Key='", "AKIA" + "ABCDEFGHIJKLMN", "0123456789abcdef", "0F" * 8]
    texts = ["".join(rng.choice([*parts_, value(24), value(12), value(40).lower()]) for _ in range(rng.randint(0, 9))) for _ in range(400)]
    rows = list(enumerate([*SECRET_TEXTS, *texts]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op8_secret_scan(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(oracle_sql()["op8_secret_scan"])
    want = sorted(tuple(r[rel.columns.index(c)] for c in got.columns) for r in rel.fetchall())
    got = sorted(tuple(r) for r in got.collect())
    assert [(a, b) for a, b in zip(got, want, strict=True) if a != b] == [] and sum(r[-1] for r in got) > 50
