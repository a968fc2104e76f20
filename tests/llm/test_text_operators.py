"""Quality rules, packing, codec, secrets and chats against plain Python."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.llm.chat_format import format_chats, parse_chats
from assayer.llm.packing import pack, plan, text_encoder, token_pieces
from assayer.llm.quality_rules import quality_rules
from assayer.llm.secret_scan import KINDS, redact, render, secret_spans
from assayer.llm.sentencepiece_codec import Codec, encode_decode

from .brute import quality, secrets, sha

WORDS_FILE, PIECES_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, n_words string, kept string"
TEXTS = [
    None, "", " \n\t", "a b c d e f g h " * 5, "x" * 5000, "the cat sat on the mat and it was good " * 3, "one line\none line\n \nother #$% line", "日本 é ñ",
    " ".join(f"w{k}" for k in range(3000)) + " w1 w2 w3 w4 w5 w6 w7 w8 w9", "a a a a a a a a a a a a a a a a a a a a a a",
]


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(texts)], schema).repartition(3)


def test_quality_rules(spark):
    rows = quality_rules(frame(spark, TEXTS)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == quality(TEXTS[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)
    assert quality_rules(frame(spark, TEXTS).limit(0)).count() == 0


def test_quality_rules_random(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    for r in quality_rules(frame(spark, texts)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality(texts[r.doc_id])


def test_quality_rules_stay_in_one_stage(spark):
    text = quality_rules(frame(spark, TEXTS).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Aggregate" not in text and "Join" not in text


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS_FILE)
    texts = [*TEXTS, "word " * 9000, "<|endoftext|> x", *["short text here"] * 40]
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    pieces = token_pieces(frame(spark, texts), WORDS_FILE)
    rows = pack(pieces.cache()).collect()
    places = collections.defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        places[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) == -(-sum(map(len, ids.values())) // 4096)
    assert pack(pieces.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=12))
def test_plan_uses_everything_once(histogram):
    used = collections.Counter()
    for lengths, times in plan(histogram, 60):
        assert sum(lengths) <= 60
        for k in lengths:
            used[k] += times
    assert dict(used) == histogram


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_encoder(text):
    from tokenizers import Tokenizer

    global _words
    if "_words" not in globals():
        _words = Tokenizer.from_file(WORDS_FILE), text_encoder(WORDS_FILE)
    tokenizer, encode = _words
    assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["It's", " ", "\n", "a,b", "é", "\x1c", "日x", "\u00a0", "[PAD]"]), max_size=9).map("".join)), max_size=6))
def test_texts_encoded_together(texts):
    encode = text_encoder(WORDS_FILE) if "_words" not in globals() else _words[1]
    encode.cache.limit = 500  # emptied often
    assert encode.many(texts) == [encode.whole(t) for t in texts]


ALPHABET = st.sampled_from(["a", "th", "e", " ", "  ", "\n", "▁", "é", "日", "🙂", "\x00", "\t", "0", "ing", "\r\n", "    ", "."])


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=50), st.lists(ALPHABET, max_size=30).map("".join)))
def test_codec_equals_the_library(text):
    import sentencepiece

    global _codec
    if "_codec" not in globals():
        _codec = sentencepiece.SentencePieceProcessor(model_file=PIECES_FILE), Codec(PIECES_FILE)
    library, codec = _codec
    want = [1, *library.encode(text), 2]
    got = codec.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert codec.decode(got) == library.decode(want)


def test_codec_frame(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES_FILE)
    texts = [*TEXTS, "y" * 30000 + " " * 500, "same", "same"]
    for r in encode_decode(frame(spark, texts), PIECES_FILE).collect():
        want = [1, *library.encode(texts[r.doc_id] or ""), 2]
        assert r.n_tokens == len(want) and np.frombuffer(r.ids, "<u4").tolist() == want and r.decoded == library.decode(want)
        assert r.decoded_sha256 == sha(r.decoded)
    assert encode_decode(frame(spark, texts).limit(0), PIECES_FILE).count() == 0


SECRET_TEXTS = [
    None, "", "token: secret: abcdefghijklmnop", 'PassWord = "abcdefghijkl" x', "api_key='short'", "AKIAABCDEFGHIJKLMN AKIA12",
    "🙂 0123456789abcdef 🙂 deadbeef", "secret=aaaaaaaaaaaa token=bbbbbbbbbbbbb\npasswd:c", "deadbeefdeadbeefx" * 400, "z" * 20000 + " apikey=0123456789ab",
    "key dGhpcyBpcyBhIHJhbmRvbSBzZWNyZXQga2V5IQ9x7Q end", "id 123e4567-e89b-12d3-a456-426614174000 end", "see aaaaaaaaaaaaaaaaaaaaaaaa1 and example-Zk3Jx8Qw1Lm5Vt7Rb2Yp",
]


def test_secrets(spark):
    found = secret_spans(frame(spark, SECRET_TEXTS))
    base = F.filter("secrets", lambda s: s["rank"] < 3)
    rows = redact(found.withColumn("base", render(base)).withColumn("all", render(F.col("secrets")))).collect()
    assert len(rows) == len(SECRET_TEXTS)
    for r in rows:
        assert r.base == secrets(SECRET_TEXTS[r.doc_id]), r.doc_id
        if not r.secrets:
            assert r.text == SECRET_TEXTS[r.doc_id]
        else:
            assert "[SECRET]" in r.text
    entropy = {r.doc_id for r in rows if any(s["rank"] == KINDS.index("entropy") for s in r.secrets)}
    assert entropy == {10}
    assert next(r.text for r in rows if r.doc_id == 10) == "key [SECRET] end"
    assert secret_spans(frame(spark, SECRET_TEXTS).limit(0)).count() == 0


def test_entropy_spans_that_base_spans_cover_in_part(spark):
    texts = [
        "a xoxb-1234567890123456-Zk3Jx8Qw1Lm5Vt7Rb2YpNc9H b",
        "a C4E19B70D2A85F3692718ab6c5d4e3f20918A7C3 b",
        "token=Zk3Jx8Qw1Lm5Vt7Rb2YpXc9N b",
    ]
    rows = redact(secret_spans(frame(spark, texts)).withColumn("all", render(F.col("secrets")))).collect()
    out = {r.doc_id: (r.all, r.text) for r in rows}
    assert out[0] == ("entropy:2:48,hex:7:23", "a [SECRET] b")
    assert out[1] == ("entropy:2:42,hex:16:38", "a [SECRET] b")
    assert out[2] == ("assign:0:30", "[SECRET] b")


def test_harmless_stretches_do_not_hide_the_rest(spark):
    value = "Zk3Jx8Qw1Lm5Vt7Rb2YpNc9H"
    texts = [f"a my_sample_key={value} b", f"a {value}//{value} b", f"a {value}AAAAAAAA b", f"a {value}/usr/lib/share b"]
    texts += ["a src//main/java/org/Foo12 b", "a sample=example-Zk3Jx8Qw1Lm5Vt7Rb2Yp b", "a //cdn/ajax/lib-x1/Zk3Jx8Qw1Lm5Vt7Rb2Yp b", "a 1zzzzzzzzzzzzzzzzzzzzzzzzzzzz b"]
    rows = redact(secret_spans(frame(spark, texts))).collect()
    assert {r.doc_id: r.text for r in rows} == {k: "a [SECRET] b" if k < 4 else t for k, t in enumerate(texts)}


def test_window_entropy(spark):
    import math

    from assayer.llm.secret_scan import CLASSES, window_entropy

    c = CLASSES[1]
    rng = random.Random(1)
    values = ["".join(rng.choice("abcXYZ019") for _ in range(rng.randint(20, 60))) for _ in range(20)] + ["a" * 30, "short"]

    def want(v):
        best = 0.0
        for i in range(len(v) - c.window + 1):
            n = collections.Counter(v[i : i + c.window]).values()
            best = max(best, -sum(k / c.window * math.log2(k / c.window) for k in n))
        return best

    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", window_entropy(F.col("v"), c).alias("e")).collect()
    for r in rows:
        assert r.e == pytest.approx(want(r.v), abs=1e-9)


TEXT = st.lists(st.sampled_from(["### ", "</turn>", "</part>", "\\", "\\h", "\n", "#", "<", "Assistant:", "x", " ", "</tu"]), max_size=8).map("".join)


def test_chats_read_back(spark):
    rng = random.Random(3)
    parts = ["### ", "</turn>", "</part>", "\\", "\\h", "\n", "#", "<", "Assistant:", "x", " ", "</tu", "\\n", ":\n"]
    rows = []
    for c in range(40):
        for k in range(rng.randint(1, 7)):
            rows.append((c, k, rng.choice(["user", "assistant", "assistant", "a\nb:", None]), rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))]), "extra"))
    rows += [(99, 1, "user", "t", "x"), (99, 1, "assistant", "t", "x"), (99, 1, "assistant", "t", "x"), (None, None, None, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    turns = collections.defaultdict(list)
    for c, k, r, t, _ in rows:
        turns[c].append((-1 if k is None else k, r or "", t or ""))
    got = parse_chats(format_chats(df)).collect()
    assert len(got) == len(turns)
    for r in got:
        want = sorted(turns[r.conv_id])
        assert [(x.role, x.text) for x in r.turns] == [x[1:] for x in want]
        assert r.loss_text == "".join(t for _, role, t in want if role == "assistant")
        assert r.formatted.count("</turn>\n") == sum(a[1] != b[1] for a, b in zip(want, want[1:])) + 1
    assert format_chats(df.limit(0)).count() == 0
