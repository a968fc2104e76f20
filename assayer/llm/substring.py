"""Substring dedup by recompression.

Naming rounds turn each document's words into ever longer symbols: one round
names runs of a repeated symbol, the others name pairs whose first symbol falls
in the left and whose second falls in the right half of a random partition. A
name is a hash of what it stands for, so it is the same everywhere without any
exchange, and equal stretches of text get equal symbols except near their ends.

For every window of ``window`` words, each round also tells which symbols the
window's own words determine, whatever stands around it. The window's anchor is
the smallest name among the determined symbols of the highest round that has
any. Equal windows thus have equal anchors at equal places, and a window whose
anchor is found nowhere else is not repeated. Neighbouring windows mostly share
their anchor: such a stretch of windows is one row, a segment, so that about a
ninth as many rows as words are exchanged.

1. Names are counted; segments whose name is unique are dropped.
2. Equal segments (name and words) are counted: all windows of a segment that
   occurs twice are repeated. Each distinct segment goes on once.
3. Where a name has several distinct segments, one copy of each lists its
   windows, which are counted by name and by a hash of all their words.
4. The repeated windows go back to their documents, which drop covered words.

Names come from one hash of each word, the keys of segments and windows from
another that is independent of it, so windows are told apart by 128 bits. A
frequent passage is one segment with a count, summed before the shuffle; nothing
is gathered but the segments of one document. A long text is worked on in parts
that overlap by a window less one word: anchors depend on a window's own words
alone, so the parts find what the whole would.

Defined cases: null and blank texts have no words; texts shorter than a window
keep all words; repeated rows count as occurrences; null ids are allowed; an
empty table gives no rows; other columns are kept by ``remove_repeats`` only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, chunks, discard, fresh, materialize
from .words import PART, all_hashes, mix, parts, word_hashes

#: Naming rounds after the words themselves: runs first, then pairs.
ROUNDS = 6
#: Windows that are worked on at once.
BLOCK = 400_000
#: So many document ids may be broadcast; more are joined by a shuffle.
FEW = 400_000

_STEP = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Stretches:
    """Hashes of any stretch of a word sequence, from running sums."""

    def __init__(self, words: np.ndarray) -> None:
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_STEP, len(words)), dtype=np.uint64)])
        self.back = _powers(_BACK, len(words) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def _rounds(words: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By round: first word and name of each symbol, and how it was read by the next round.

    The third tells, for each symbol, the next round's symbol that holds it (a run)
    or whether it is a left one (a pair round); the last how many of the next
    round's symbols open before it.
    """
    start, name, out = np.arange(len(words)), words, []
    for k in range(ROUNDS):
        joined = np.zeros(len(start), bool)  # with the symbol before, in one document
        joined[1:] = doc[start[1:]] == doc[start[:-1]]
        if k == 0:
            joined[1:] &= name[1:] == name[:-1]
            first = np.flatnonzero(~joined)
            n = np.diff(np.append(first, len(start))).astype(np.uint64)
            new = np.where(n > 1, mix(name[first] * np.uint64(3) + n * np.uint64(0x9E3779B97F4A7C15)), name[first])
            read = np.cumsum(~joined) - 1
        else:
            read = (mix(name + np.uint64(k << 40)) >> np.uint64(63)).astype(bool)
            joined[1:] &= read[:-1] & ~read[1:]
            first = np.flatnonzero(~joined)
            pair = np.zeros(len(start), bool)
            pair[:-1] = joined[1:]
            after = np.append(name[1:], np.uint64(0))
            new = np.where(pair, mix(name * np.uint64(5) + mix(after + np.uint64(77))), name)[first]
        out.append((start, name, read, np.concatenate([[0], np.cumsum(~joined)])))
        start, name = start[first], new
    return [*out, (start, name, start, start)]


def segments(words: np.ndarray, other: np.ndarray, firsts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, name, key) of all segments of some documents.

    Names come from ``words``, keys from the ``other`` hashes of the same words.
    """
    doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    rounds = _rounds(words, doc)
    plain, stretch = Stretches(words), Stretches(other)
    last = firsts[1:][doc]
    all_windows = np.flatnonzero(np.arange(len(words)) + window <= last)
    out = []
    for at in range(0, len(all_windows), BLOCK):
        p = all_windows[at : at + BLOCK]
        level, anchor = np.zeros(len(p), np.int64), p.copy()
        name = plain.of(p, p + window)
        low, high, ranges = p, p + window, []  # the determined symbols of each round, as indexes
        for k in range(ROUNDS):
            _, _, read, opened = rounds[k]
            fine = low < high
            lo, hi = np.where(fine, low, 0), np.where(fine, high, 1)
            if k == 0:  # the runs at either end may go on outside
                low, high = read[lo] + 1, read[hi - 1]
            else:  # a right symbol at the start, or a left one at the end, may belong to a pair outside
                low, high = opened[lo + ~read[lo]], opened[hi - read[hi - 1]]
            low, high = np.where(fine, low, 0), np.where(fine, high, 0)
            some = low < high
            if not some.any():
                break
            level[some] = k + 1
            ranges.append((low, high))
        # The anchor comes from the highest round that determines any symbol.
        for k, (low, high) in enumerate(ranges):
            there = np.flatnonzero(level == k + 1)
            if not len(there):
                continue
            names = rounds[k + 1][1]
            order = mix(names + np.uint64(9))
            a, b = low[there], high[there]
            best, least = a, order[a]
            for step in range(1, int((b - a).max())):
                at_step = np.minimum(a + step, b - 1)
                value = order[at_step]
                less = value < least
                best, least = np.where(less, at_step, best), np.where(less, value, least)
            anchor[there], name[there] = rounds[k + 1][0][best], names[best]
        opens = np.ones(len(p), bool)
        opens[1:] = (level[1:] != level[:-1]) | (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1) | (level[1:] == 0)
        head = np.flatnonzero(opens)
        n = np.diff(np.append(head, len(p)))
        begin = p[head]
        key = stretch.of(begin, begin + n + window - 1)
        key = mix(key + mix((anchor[head] - begin + level[head] * 1024).astype(np.uint64)))
        out.append((begin, n, name[head], key))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``k1, k2, text``: a key that tells rows with different ids or texts apart."""
    t, i = F.col(text).cast("string"), F.col(doc_id).cast("long")
    return docs.select(F.xxhash64(i, t).alias("k1"), F.coalesce(i, F.lit(-1)).alias("k2"), t.alias("text"))


def _overlapping(data: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first word, hashes, other hashes) of the parts of a long text, a window less one word in common."""
    at, index, size = 0, 0, PART
    while True:
        end = at + next(e for _, e in parts(data[at:]) if e >= min(size, len(data) - at))
        words, start, _, _, other = word_hashes(data[at:end], np.array([0, end - at]), lower=False, second=True)
        if end < len(data) and len(words) < 2 * window:  # words of huge length
            size *= 2
            continue
        yield index, words, other
        if end == len(data):
            return
        index += len(words) - window + 1
        at += int(start[len(words) - window + 1])


def _find_segments(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in chunks(batch.column(2)):
                if len(offsets) == 2 and len(data) > PART:
                    found = ((i, w, o, np.array([0, len(w)])) for i, w, o in _overlapping(data, window))
                else:
                    words, _, _, firsts, other = word_hashes(data, offsets, lower=False, second=True)
                    found = iter([(0, words, other, firsts)])
                for index, words, other, firsts in found:
                    begin, n, name, key = segments(words, other, firsts, window)
                    doc = np.searchsorted(firsts, begin, "right") - 1
                    k1, k2 = (batch.column(c).to_numpy()[row + doc] for c in (0, 1))
                    at = (begin - firsts[doc] + index).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in (k1, k2, at, n.astype(np.int32), name.view(np.int64), key.view(np.int64))],
                        ["k1", "k2", "at", "n", "name", "key"],
                    )

    return docs.mapInArrow(run, "k1 long, k2 long, at int, n int, name long, key long")


def _list_windows(texts: DataFrame, window: int) -> DataFrame:
    """One row per window of the listed segments: ``name, key, offset, hash, copies``."""

    def rows(words: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Windows of segments ``name, key, copies, n, at``, in order of ``at``, some at a time."""
        ends = found[4] + found[3] + window - 1
        first = 0
        while first < found.shape[1]:
            low = found[4][first]
            last = max(first + 1, int(np.searchsorted(found[4], low + BLOCK)))
            last = min(last, first + max(1, int(np.searchsorted(np.cumsum(found[3][first:]), BLOCK))))
            name, key, copies, n, at = found[:, first:last]
            stretch = Stretches(words[low : ends[first:last].max()])
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            p = np.repeat(at, n) + offset - low
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (np.repeat(name, n), np.repeat(key, n), offset.astype(np.int32), stretch.of(p, p + window).view(np.int64), np.repeat(copies, n))],
                ["name", "key", "offset", "hash", "copies"],
            )
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            starts, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            table = np.stack([flat.field(c).to_numpy().astype(np.int64) for c in ("name", "key", "copies", "n", "at")])
            for row, end, data, offsets in chunks(batch.column(0)):
                if len(offsets) == 2:
                    words, firsts = all_hashes(data, lower=False, second=True), np.zeros(1, np.int64)
                else:
                    _, _, _, firsts, words = word_hashes(data, offsets, lower=False, second=True)
                found = table[:, starts[row] : starts[end]].copy()
                found[4] += np.repeat(firsts[: end - row], np.diff(starts[row : end + 1]))
                yield from rows(words, found[:, np.argsort(found[4], kind="stable")])

    return texts.mapInArrow(run, "name long, key long, offset int, hash long, copies long")


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """``k1, k2, spans``: for each document with repeated windows, (at, n, offsets) of its segments.

    ``offsets`` is null where all n windows from ``at`` on are repeated, else it
    lists those that are.
    """
    found = materialize(_find_segments(docs, window), "segments")
    # Key tables are stored first: both sides of a join are then plain shuffles, which
    # adaptive execution can split where a name or a window is very common.
    names = materialize(found.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name"), "names")
    shared = materialize(found.join(names, "name", "left_semi"), "shared")
    discard(found, names)
    where = F.struct("k1", "k2", "at", "n")
    distinct = materialize(shared.groupBy("name", "key").agg(F.count("*").alias("copies"), F.min(where).alias("one")), "distinct")
    several = materialize(distinct.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name"), "several")
    listed = distinct.join(several, "name", "left_semi").select("one.k1", "one.k2", F.struct("one.at", "one.n", "name", "key", "copies").alias("s"))
    listed = listed.groupBy("k1", "k2").agg(F.collect_list("s").alias("list"))
    listed = materialize(listed, "listed")
    # Equal rows have equal keys: one of them is enough here.
    texts = _matching(docs, listed.select("k1", "k2"))[0].groupBy("k1", "k2").agg(F.first("text").alias("text"))
    windows = materialize(_list_windows(texts.join(listed, ["k1", "k2"]).select("text", "list"), window), "windows")
    again = materialize(windows.groupBy("name", "hash").agg(F.sum("copies").alias("c")).where("c > 1").select("name", "hash"), "again")
    partly = windows.where("copies = 1").join(again, ["name", "hash"], "left_semi")
    partly = partly.groupBy("name", "key").agg(F.collect_list("offset").alias("offsets"))
    wholly = distinct.where("copies > 1").select("name", "key", F.lit(None).cast("array<int>").alias("offsets"))
    marked = shared.join(partly.unionByName(wholly), ["name", "key"])
    spans = materialize(marked.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "n", "offsets")).alias("spans")), "spans")
    discard(shared, distinct, several, listed, windows, again)
    return spans


def _matching(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a key in ``keys`` and those without; few keys are broadcast, after counting."""
    small, on = keys.limit(FEW + 1).count() <= FEW, keys.columns
    keys = F.broadcast(keys) if small else keys
    return docs.join(keys, on, "left_semi"), docs.join(keys, on, "left_anti")


def remove_repeats(docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text", words_only: bool = False, text_only: bool = False) -> DataFrame:
    """Removes every word covered by a window of words that also starts elsewhere.

    Adds ``n_words``, ``n_removed`` and ``kept_sha256`` (of the kept words joined by
    one space) to the input columns, replacing columns of those names, and puts the
    kept text into ``text``: the text without the removed stretches. With
    ``words_only`` the result is the id and the three new columns, with ``text_only``
    the input columns alone.
    """
    bound_batches(docs.sparkSession)
    added = ["n_words", "n_removed", "kept_sha256"]
    names = [doc_id, text] if words_only else [c for c in docs.columns if text_only or c.lower() not in added]
    keyed = _keyed(docs, doc_id, text)
    spans = repeated_windows(keyed, window)
    t, i = F.col(text).cast("string"), F.col(doc_id).cast("long")
    k1, k2, marked = fresh(docs, "k1", "k2", "spans")
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(i, t).alias(k1), F.coalesce(i, F.lit(-1)).alias(k2))
    spans = spans.withColumnsRenamed({"k1": k1, "k2": k2, "spans": marked})
    hit, rest = _matching(rows, spans.select(k1, k2))
    both = hit.join(spans, [k1, k2]).unionByName(rest.withColumn(marked, F.lit(None).cast(spans.schema[marked].dataType)))
    both = both.select(*[F.col(f"`{c}`") for c in names], marked)
    at = names.index(text)
    out_names = [doc_id] if words_only else names
    schema = ", ".join([*(f"`{c}` {both.schema[c].dataType.simpleString()}" for c in out_names), *([] if text_only else ["n_words long, n_removed long, kept_sha256 string"])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_words, n_removed, digests = [], [], [], []
            for value, found in zip(batch.column(at), batch.column(len(names)), strict=True):
                covered = _covered(found.as_py(), window) if found.is_valid else None
                raw = value.as_buffer() if value.is_valid else pa.py_buffer(b"")
                n, removed, digest, kept = _kept(raw, covered, want_text=not words_only)
                texts.append(None if words_only else value.as_py() if covered is None else kept.decode())
                n_words.append(n)
                n_removed.append(removed)
                digests.append(digest)
            kept = [pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names)) if names[k] in out_names]
            counts = [] if text_only else [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *counts], [*out_names, *added[: len(counts)]])

    return both.mapInArrow(run, schema)


def _covered(spans: list[dict], window: int) -> list[tuple[int, int]]:
    """Ranges of words under repeated windows, apart and in order."""
    first = np.concatenate([s["at"] + (np.arange(s["n"]) if s["offsets"] is None else np.array(s["offsets"])) for s in spans])
    first.sort()
    opens = np.flatnonzero(np.diff(first, prepend=first[0] - window - 1) > window)
    last = np.append(first[opens[1:] - 1], first[-1])
    return list(zip(first[opens].tolist(), (last + window).tolist(), strict=True))


def _kept(raw: pa.Buffer, covered: list[tuple[int, int]] | None, want_text: bool) -> tuple[int, int, str, bytes]:
    """(words, removed words, digest of the kept words joined by a space, text without the removed words).

    A removed word goes with the white space after it. The text is read in parts.
    """
    digest, before, removed, some, out = hashlib.sha256(), 0, 0, False, []
    data = np.frombuffer(raw, np.uint8)
    for a, b in parts(data):
        piece = data[a:b].tobytes()
        words = piece.split()
        here = [(max(x - before, 0), min(y - before, len(words))) for x, y in covered or () if x < before + len(words) and y > before]
        if here:
            gone = sum(y - x for x, y in here)
            edges = [0, *(e for xy in here for e in xy), len(words)]
            stay = [(x, y) for x, y in zip(edges[0::2], edges[1::2], strict=True) if x < y]
            if want_text:
                out.append(_without(piece, stay))
            words = [w for x, y in stay for w in words[x:y]]
            removed, before = removed + gone, before + gone
        elif want_text and covered is not None:
            out.append(piece)
        before += len(words)
        if words:
            digest.update((b" " if some else b"") + b" ".join(words))
            some = True
    return before, removed, digest.hexdigest(), b"".join(out)


def _without(raw: bytes, stay: list[tuple[int, int]]) -> bytes:
    """``raw`` with the ranges of its words that stay, and the white space after each word."""
    _, start, _, _ = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=False)
    edges = np.append(start, len(raw))
    return b"".join([raw[: edges[0]], *(raw[edges[x] : edges[y]] for x, y in stay)])
