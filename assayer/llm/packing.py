"""Best-fit packing by minimum bin slack.

Pieces are at most ``size`` tokens long, so all that packing needs to know about
a corpus is how many pieces there are of each length: at most ``size`` numbers,
however large the corpus. The driver plans on that histogram; Spark then numbers
the pieces within each length and looks every number up in the plan.

Plan: per bin, the longest remaining length is fixed and a bitset subset-sum
dynamic programme over the remaining lengths finds the fullest feasible
combination. That combination is removed as often as the counts allow, which
uses up at least one length; so the number of dynamic programmes is bounded by
the number of lengths and not by the number of bins.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, fresh, materialize, per_process

#: Longer words are encoded anew each time; so many characters of a text are split at once.
LONGEST, PART = 64, 1 << 20
#: So many characters of shorter texts are encoded together.
TOGETHER = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each at most as often as counted, whose sum is the largest up to ``room``.

    Bit s of ``reach[k]`` says that the first k items can sum to s. Counts are
    split into powers of two, so an item is a (length, times) pair.
    """
    items: list[tuple[int, int]] = []
    for length, n in sorted(counts.items(), reverse=True):
        n, power = min(n, room // length), 1
        while n > 0:
            items.append((length, min(power, n)))
            n -= power
            power *= 2
    mask, reach = (1 << (room + 1)) - 1, [1]
    for length, times in items:
        before = reach[-1]
        reach.append(before | (before << (length * times)) & mask)
        if reach[-1] >> room:
            break
    left, out = reach[-1].bit_length() - 1, []
    for k in range(len(reach) - 1, 0, -1):
        if not reach[k - 1] >> left & 1:
            length, times = items[k - 1]
            out += [length] * times
            left -= length * times
    return out


def plan(histogram: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """(lengths of one bin, number of such bins), using up ``histogram``."""
    counts, out = {k: n for k, n in histogram.items() if n > 0}, []
    while counts:
        top = max(counts)
        counts[top] -= 1
        bin_ = [top, *fullest({k: n for k, n in counts.items() if n and k <= size - top}, size - top)]
        counts[top] += 1
        need = Counter(bin_)
        times = min(counts[k] // n for k, n in need.items())
        for k, n in need.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((bin_, times))
    return out


def _slots(bins: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence and offset of each run of places."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    first = 0
    for lengths, times in bins:
        at = 0
        for k in lengths:
            found.setdefault(k, []).append((used[k], first, at))
            used[k] += times
            at += k
        first += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in found.items()}


# The parts of the tokenizer file that caching relies on.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cacheable(path: str) -> bool:
    """Whether the file's normaliser and pre-tokenizer are the ones that the cache knows."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normalizer = spec.get("normalizer") or {}
    steps = [{k: v for k, v in step.items() if k in ("type", "pattern", "content")} for step in normalizer.get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = splits[0] if splits else {}
    known = first.get("type") == "Split" and first.get("pattern") == {"Regex": SPLIT} and first.get("behavior") == "Removed" and first.get("invert") is True
    return steps == NORMALIZER and known and [x["type"] for x in splits[1:]] == ["ByteLevel"]


#: Letters beyond ASCII that are one code point in normal form and whose lower case is one letter too.
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
#: What is encoded on its own: the parts of ``SPLIT`` in either case ...
PARTS = rf"[A-Za-z{LATIN}]+|[0-9]|'(?:[sStTmMdD]|[rRvV][eE]|[lL][lL])|[^\sA-Za-z0-9{LATIN}]+"
#: ... and whole words that hold any other character.
OTHERS = rf"(?<!\S)(?=\S*[^\x21-\x7e\s{LATIN}])\S+"
_PLAIN_UNITS, _UNITS = re.compile(PARTS), re.compile(f"{OTHERS}|{PARTS}")
_PLAIN_LINES, _LINES = re.compile(rf"{PARTS}|\n"), re.compile(rf"{OTHERS}|{PARTS}|\n")
#: Stands between the ids of two words; no token has this id.
BETWEEN = 0xFFFFFFFF
_PLAIN_TEXT = re.compile(rf"[\s\x21-\x7e{LATIN}]*")
_PLAIN = re.compile(rf"[\x21-\x7e{LATIN}]+")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in the model: printable Latin-1 as it is, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


class UnitCache(dict):
    """unit -> ids as bytes, from the tokenizer's own parts; emptied when it holds ``limit`` bytes.

    A unit encodes alike wherever it stands, because the pre-tokenizer cuts there
    and no merge crosses a cut. Long units are not kept. A line break, which is in no
    unit, gives ``BETWEEN``.
    """

    def __init__(self, tokenizer, limit: int = 120 << 20) -> None:
        self.limit, self.model, self.held = limit, tokenizer.model, 0
        self.normalizer, self.split, self.letters = tokenizer.normalizer, tokenizer.pre_tokenizer, _byte_letters()

    def _ids(self, unit: str) -> bytes:
        tokens = self.model.tokenize(unit)
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def __missing__(self, unit: str) -> bytes:
        if unit == "\n":
            ids = struct.pack("<I", BETWEEN)
        elif _PLAIN.fullmatch(unit):
            ids = self._ids(unit.lower() if unit.isascii() else unit.lower().encode().decode("latin-1").translate(self.letters))
        else:
            parts = self.split.pre_tokenize_str(self.normalizer.normalize_str(unit))
            ids = b"".join(self._ids(p) for p, _ in parts)
        if len(unit) <= LONGEST:
            if self.held > self.limit:
                self.clear()
                self.held = 0
            self[unit] = ids
            self.held += 200 + 2 * len(unit) + len(ids)
        return ids


def units(text: str) -> list[str]:
    return (_PLAIN_UNITS if _PLAIN_TEXT.fullmatch(text) else _UNITS).findall(text)


class TextEncoder:
    """text -> ids as little-endian 32-bit bytes, as the library encodes without special tokens added.

    Files with another normaliser or pre-tokenizer than the known ones go through the library whole.
    """

    #: Separators that Python splits at and the tokenizer does not.
    odd = tuple(chr(c) for c in range(0x1C, 0x20))

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache = UnitCache(self.tokenizer) if cacheable(path) else None
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def by_units(self, text: str) -> bool:
        return self.cache is not None and not any(s in text for s in self.special) and not any(c in text for c in self.odd)

    def __call__(self, text: str) -> bytes:
        if not self.by_units(text):
            return self.whole(text)
        if len(text) <= PART:
            return b"".join(map(self.cache.__getitem__, units(text)))
        return b"".join(b"".join(map(self.cache.__getitem__, units(part))) for part in _parts(text))

    def many(self, texts: list[str]) -> list[bytes]:
        """The same for each text; those that are cut into units share the work on equal words.

        No unit crosses white space, so each distinct word of the texts is cut and
        encoded once and its ids are copied to where it stands.
        """
        shared = [i for i, t in enumerate(texts) if len(t) <= PART and self.by_units(t)]
        out = dict(zip(shared, self._shared([texts[i] for i in shared]) if shared else (), strict=True))
        return [out[i] if i in out else self(t) for i, t in enumerate(texts)]

    def _shared(self, texts: list[str]) -> list[bytes]:
        words = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
        coded = pc.dictionary_encode(words.flatten())
        word, distinct = coded.indices.to_numpy(), coded.dictionary
        lines = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct), "\n")[0].as_py()
        found = (_PLAIN_LINES if _PLAIN_TEXT.fullmatch(lines) else _LINES).findall(lines)
        ids = np.frombuffer(b"".join(map(self.cache.__getitem__, found)), "<u4")
        cuts = np.flatnonzero(ids == BETWEEN)
        first, last = np.concatenate([[0], cuts + 1]), np.append(cuts, len(ids))
        length = (last - first)[word]
        ends = np.concatenate([[0], np.cumsum(length)])
        raw = ids[np.repeat(first[word] - ends[:-1], length) + np.arange(ends[-1])].tobytes()
        edges = 4 * ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return [raw[a:b] for a, b in pairwise(edges.tolist())]


def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def _together(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``TOGETHER`` characters."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if i > first and held + len(t) > TOGETHER:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that end where white space begins."""
    at, space = 0, re.compile(r"\s")
    while len(text) - at > PART and (found := space.search(text, at + PART)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def token_pieces(df: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and the ``ids`` themselves.

    A document is its ids followed by ``end_id``; only longer documents than
    ``size`` are cut, every ``size`` tokens. Null text is empty: one token.
    """
    step = 4 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_process(("encoder", tokenizer_path), lambda: text_encoder(tokenizer_path))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "").to_pylist()
            for low, high in _together(texts):
                rows = []
                for doc, ids in zip(docs[low:high], encode.many(texts[low:high]), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        p = ids[at : at + step]
                        rows.append((doc, k, at // 4, len(p) // 4, zlib.crc32(p), p))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    bound_batches(df.sparkSession)
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"{PIECES}, ids binary")


def pack(pieces: DataFrame, size: int = 4096, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``: places without gaps in sequences of at most ``size``.

    ``pieces`` needs a ``length`` from 1 to ``size``. Its rows are stored with a
    bucket each, dealt in turn, whatever they hold; pieces of one length are
    interchangeable, so they are numbered within (length, bucket), buckets are
    numbered by running counts, and a common length, a null id or a repeated row is
    spread over as many tasks as there are buckets. Repeated rows and null ids are
    packed each; an empty table gives an empty result; columns named
    ``sequence_id`` or ``offset`` are replaced, all others are kept.
    """
    spark = pieces.sparkSession
    pieces = pieces.select(*[F.col(f"`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")])
    bucket, rank, before, place_ = fresh(pieces, "bucket", "rank", "before", "place")
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    bucketed = materialize(pieces.withColumn(bucket, F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).cast("int")), "pieces")
    counts = materialize(bucketed.groupBy("length", bucket).agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if any(not 1 <= k <= size for k in histogram):
        raise ValueError(f"lengths must be from 1 to {size}")
    slots = _slots(plan(histogram, size))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("length", bucket, F.coalesce(earlier, F.lit(0)).alias(before))
    order = Window.partitionBy("length", bucket).orderBy(*keys)
    ranked = bucketed.withColumn(rank, F.row_number().over(order) - 1).join(firsts, ["length", bucket])
    shared = spark.sparkContext.broadcast(slots)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        order = np.argsort(n, kind="stable")
        cut = np.flatnonzero(np.diff(n[order])) + 1
        for rows in np.split(order, cut) if len(n) else []:
            ranks, first, at = shared.value[int(n[rows[0]])]
            k = np.searchsorted(ranks, r[rows], "right") - 1
            seq[rows], off[rows] = first[k] + r[rows] - ranks[k], at[k]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    placed = ranked.withColumn(place_, place("length", F.col(rank) + F.col(before)))
    return placed.select(*[F.col(f"`{c}`") for c in pieces.columns], F.col(place_)["sequence_id"].alias("sequence_id"), F.col(place_)["offset"].alias("offset"))
