"""SentencePiece encoding and decoding for merge-type (BPE) models.

Encoding is exact and does not merge a text: an Aho-Corasick automaton lists the
pieces that start at each position, the longest is tried first, and a piece is
kept if it is compatible with the one before it, that is, if re-merging the two
surfaces gives the same two pieces. A position from which no piece works is
marked in a bitfield and never tried again. Every adjacent pair being
compatible makes the sequence the one that merging yields.

No piece of the model has a word mark after another character, or a line break,
so the stretches between those places encode independently; frequent ones are
cached, the cache is emptied when full. Stretches that start with several word
marks are re-merged whole, since the model gives all such runs one score.
Characters without a piece are encoded as their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, per_process

MARK = "▁"
#: Characters of one text that are taken apart at once.
PART = 1 << 20
NORMAL, CONTROL, BYTE = 1, 3, 6


class Stretches(dict):
    """stretch -> its ids, in two generations: when the younger is full it becomes the elder, whose unused entries go.

    Long stretches are not kept.
    """

    def __init__(self, encode: Callable[[str], bytes], limit: int) -> None:
        self.encode, self.limit, self.elder = encode, limit // 2, {}

    def __missing__(self, text: str) -> bytes:
        found = self.elder.get(text)
        if found is None:
            found = self.encode(text)
        if len(text) <= 48:
            if len(self) >= self.limit:
                self.elder = dict(self)
                self.clear()
            self[text] = found
        return found


class Codec:
    """Encoder and decoder for one model file; it holds no text but its cache."""

    def __init__(self, path: str, stretches: int = 1_200_000, limit: int = 400_000) -> None:
        """``stretches`` and ``limit`` (of piece pairs) bound the caches: some 300 and 60 MB."""
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces:
            raise ValueError("a BPE model with the identity normalizer is needed")
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.begin, self.end = model.trainer_spec.bos_id, model.trainer_spec.eos_id
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("pieces must not go beyond a word mark or a line break")
        self.letters = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) == 1 or self.merge(p) == [p]:
                self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        #: The next shorter piece that a piece starts with; the empty string ends the chain.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.automaton), "") for p in self.automaton}
        self.units = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
        #: The last character of a stretch, where another begins.
        self.edges = re.compile(f"[^{MARK}](?={MARK})|\n")
        self.limit, self.cache, self.pairs = limit, Stretches(self.unit, stretches), {}
        self.text_of = [
            p if k == NORMAL else "" if k in (CONTROL, BYTE) else model.trainer_spec.unk_surface
            for p, k in zip(self.pieces, self.kinds, strict=True)
        ]

    def merge(self, text: str) -> list[str]:
        """Merges adjacent symbols, best score first, leftmost among equals."""
        parts: list[str | None] = list(text)
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (score := self.scores.get(joined := parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-score, a, b, joined))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != joined:
                continue
            parts[a], parts[b] = joined, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def compatible(self, a: str, b: str) -> bool:
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(a + b) == [a, b]
        return known

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text whose characters all are pieces.

        Kept for each position: its longest piece (a reference) and whether it has
        failed (one bit).
        """
        if text in self.shorter:
            return [text]
        n = len(text)
        longest = [""] * (n + 1)
        for last, (before, piece) in self.automaton.iter(text):  # by end, so the longest of a start comes last
            longest[last - before] = piece
        failed, failures = bytearray((n >> 3) + 1), 0
        out: list[str] = []
        at, last, shorter, pairs, compatible = 0, None, self.shorter, self.pairs, self.compatible
        piece = longest[0]
        while at < n:
            while piece:
                end = at + len(piece)
                if not (failures and failed[end >> 3] >> (end & 7) & 1):
                    if last is None:
                        break
                    fits = pairs.get((last, piece))
                    if fits or (fits is None and compatible(last, piece)):
                        break
                piece = shorter[piece]
            if piece:
                out.append(piece)
                at, last = end, piece
                piece = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                failures += 1
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else None
                piece = shorter[piece]
        return out

    def unit(self, text: str) -> bytes:
        """The ids of one independent stretch, as little-endian 32-bit bytes."""
        if text.startswith(MARK * 2):
            parts = self.merge(text)
        elif self.letters.issuperset(text):
            parts = self.backtrack(text)
        else:
            parts, at = [], 0
            for i, c in enumerate(text):
                if c not in self.letters:
                    parts += [*self.backtrack(text[at:i]), c]
                    at = i + 1
            parts += self.backtrack(text[at:])
        known = self.ids
        ids: list[int] = []
        for p in parts:
            if p in known:
                ids.append(known[p])
            else:
                ids += [self.bytes[b] for b in p.encode()]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _parts(self, text: str) -> Iterator[str]:
        """A text in parts of about ``PART`` characters that end where a stretch does."""
        at = 0
        while len(text) - at > PART:
            end = self.edges.search(text, at + PART)
            if end is None:
                break
            yield text[at : end.start() + 1]
            at = end.start() + 1
        yield text[at:] if at else text

    def encode(self, text: str, begin: bool = True, end: bool = True) -> bytes:
        out = [np.array([self.begin], "<u4").tobytes()] if begin else []
        if text:
            for part in self._parts((self.prefix + text).replace(" ", MARK)):
                out.append(b"".join(map(self.cache.__getitem__, self.units.findall(part))))
        if end:
            out.append(np.array([self.end], "<u4").tobytes())
        return b"".join(out)

    def _bytes(self, run: bytes) -> str:
        """UTF-8, with one replacement character for each byte that fits nowhere."""
        out = []
        while run:
            try:
                out.append(run.decode())
                break
            except UnicodeDecodeError as e:
                out.append(run[: e.start].decode() + "�")
                run = run[e.start + 1 :]
        return "".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids: marks become spaces, the dummy prefix goes."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        of = self.byte_of
        if of.keys().isdisjoint(numbers):
            text = "".join(map(self.text_of.__getitem__, numbers))
        else:
            parts, run = [], bytearray()
            for i in numbers:
                if i in of:
                    run.append(of[i])
                    continue
                if run:
                    parts.append(self._bytes(bytes(run)))
                    run.clear()
                parts.append(self.text_of[i])
            parts.append(self._bytes(bytes(run)))
            text = "".join(parts)
        if self.prefix and text.startswith(MARK):
            text = text[1:]
        return text.replace(MARK, " ")


def encode_decode(df: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` and ``decoded``.

    Whole texts, with begin and end ids. Null text is empty: two ids and an empty
    decoded text. Repeated rows are encoded each; an empty table gives no rows;
    other input columns are ignored. A projection: no shuffle.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = per_process(("codec", model_path), lambda: Codec(model_path))
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                rows = []
                for doc, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = codec.encode(t or "")
                    back = codec.decode(ids)
                    row = (doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
                    rows.append((*row, ids, back) if keep_ids else row)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    bound_batches(df.sparkSession)
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, schema)
