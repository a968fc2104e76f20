"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded by
a small network over its character statistics; gated attention, learned from
document labels alone, weighs the passages, and the weighted representation is
scored by a logistic unit.

The network is fitted on the driver on a sample of labelled documents, each with
all its passages: at most ``SAMPLE`` documents, the smallest by a hash of the id,
and of these, in that order, those that fit into ``PASSAGES`` passages in all. So
the bound is on documents, never within one. Scoring is one pass over every
passage of every whole text, without a shuffle; the weights are a few kilobytes.

Defined cases: null and empty texts are one passage of zeros; documents with
several labels take the largest; null labels are left out; with no label, or
labels of one kind, every score is the share of label 1 (0.5 without labels);
repeated rows are scored each, and learned from each (they count as one document
for the bound); an empty table gives no rows; other input columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, chunks
from .words import PART

PASSAGE, SAMPLE, PASSAGES = 512, 4000, 100_000
#: Fitting ends after ``ROUNDS``, or when the loss fell by less than ``STILL`` of itself in the last ``SPAN`` rounds.
HIDDEN, GATES, ROUNDS, SPAN, STILL = 24, 12, 400, 25, 1e-3

#: Byte -> class: letters without case, digits, white space, each ASCII mark, all other bytes.
_CLASS = np.full(256, 63, np.int64)
for _i in range(26):
    _CLASS[65 + _i] = _CLASS[97 + _i] = _i
_CLASS[48:58] = 26
_CLASS[[9, 13, 32]] = 27
_CLASS[10] = 28
for _k, _c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASS[ord(_c)] = 29 + _k
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
FEATURES = 64 + 5


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(statistics by passage, first passage of each document); a passage is judged by its own bytes alone."""
    if len(offsets) == 2 and len(data) > PART:
        found = [_passages(data[a : a + PART], np.array([0, min(PART, len(data) - a)]))[0] for a in range(0, len(data), PART)]
        return np.concatenate(found), np.zeros(1, np.int64)
    return _passages(data, offsets)


def _passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-sizes // PASSAGE))
    firsts = np.concatenate([[0], np.cumsum(n)])
    total = int(firsts[-1])
    at = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    bag = np.repeat(firsts[:-1], sizes) + at // PASSAGE
    inside = at % PASSAGE
    kind = _CLASS[data]
    x = np.bincount(bag * 64 + kind, minlength=total * 64).reshape(total, 64).astype(np.float32)
    upper = np.bincount(bag, _UPPER[data], total)
    blank = (kind == 27) | (kind == 28)
    opens = ~blank & ((inside == 0) | np.concatenate([[True], blank[:-1]])[: len(kind)])
    words = np.bincount(bag, opens, total)
    # Bytes equal to the one two before them; distinct pairs against all pairs: repetition.
    same = np.bincount(bag[2:], (data[2:] == data[:-2]) & (inside[2:] > 1), total)
    pair = (bag[1:] * 4096 + kind[:-1] * 64 + kind[1:])[inside[1:] > 0]
    distinct = np.bincount(np.unique(pair) >> 12, minlength=total)
    length = np.maximum(1, x.sum(1))
    extra = np.stack(
        [upper / np.maximum(1, x[:, :26].sum(1)), x[:, :26].sum(1) / np.maximum(1, words) / 10, same / length, distinct / length, length / PASSAGE], 1
    )
    return np.concatenate([np.sqrt(x / length[:, None]), extra], 1).astype(np.float32), firsts[:-1]


def _forward(m: dict[str, np.ndarray], x: np.ndarray, firsts: np.ndarray) -> dict[str, np.ndarray]:
    doc = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(x))))
    h = np.tanh((x - m["mean"]) / m["scale"] @ m["w"] + m["b"])
    t, s = np.tanh(h @ m["v"] + m["bv"]), 1 / (1 + np.exp(-(h @ m["u"] + m["bu"])))
    e = t * s @ m["a"]
    e = np.exp(e - np.maximum.reduceat(e, firsts)[doc])
    e /= np.add.reduceat(e, firsts)[doc]
    z = np.add.reduceat(e[:, None] * h, firsts, axis=0)
    return {"doc": doc, "h": h, "t": t, "s": s, "e": e, "z": z, "p": 1 / (1 + np.exp(-(z @ m["c"] + m["d"])))}


def fit(x: np.ndarray, firsts: np.ndarray, y: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights by full-batch Adam on the log-loss with a small weight decay, until the loss is still."""
    r = np.random.default_rng(seed)
    m = {
        "w": r.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN),
        "v": r.normal(0, 0.3, (HIDDEN, GATES)), "bv": np.zeros(GATES), "u": r.normal(0, 0.3, (HIDDEN, GATES)), "bu": np.zeros(GATES),
        "a": r.normal(0, 0.3, GATES), "c": r.normal(0, 0.3, HIDDEN), "d": np.zeros(1),
    }
    fixed = {"mean": x.mean(0), "scale": x.std(0) + 1e-3}
    first, second = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    xs = (x - fixed["mean"]) / fixed["scale"]
    losses: list[float] = []
    for k in range(1, ROUNDS + 1):
        f = _forward(m | fixed, x, firsts)
        losses.append(float(-np.log(np.clip(np.where(y == 1, f["p"], 1 - f["p"]), 1e-12, 1)).mean()))
        if k > 2 * SPAN and min(losses[:-SPAN]) - min(losses[-SPAN:]) < STILL * min(losses):
            break
        doc, h, t, s, e = (f[n] for n in ("doc", "h", "t", "s", "e"))
        error = (f["p"] - y) / len(y)
        dz = error[:, None] * m["c"]
        de = (h * dz[doc]).sum(1)
        dl = e * (de - np.add.reduceat(e * de, firsts)[doc])
        dg = dl[:, None] * m["a"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (e[:, None] * dz[doc] + dt @ m["v"].T + ds @ m["u"].T) * (1 - h * h)
        grad = {
            "w": xs.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "bv": dt.sum(0), "u": h.T @ ds, "bu": ds.sum(0),
            "a": (t * s).T @ dl, "c": f["z"].T @ error, "d": error.sum(keepdims=True),
        }
        rate = 0.02 * min(1.0, 2 * (1 - k / (ROUNDS + 1)))
        for n, g in grad.items():
            g = g + 2e-4 * m[n] * (m[n].ndim > 1)
            first[n] = 0.9 * first[n] + 0.1 * g
            second[n] = 0.999 * second[n] + 0.001 * g * g
            m[n] = m[n] - rate * first[n] / (1 - 0.9**k) / (np.sqrt(second[n] / (1 - 0.999**k)) + 1e-8)
    return {n: v.astype(np.float32) for n, v in (m | fixed).items()}


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> dict[str, np.ndarray]:
    """The network, or ``{"share": ...}`` where labels of both kinds are missing."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    known = known.groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # At most SAMPLE rows of two numbers are broadcast, and about as many come back.
    sample = texts.join(F.broadcast(known), "doc_id")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / PASSAGE)).alias("size")
    sizes = sample.select("doc_id", size).groupBy("doc_id").agg(F.sum("size").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    chosen, total = [], 0
    for r in sizes:
        if total + r["size"] <= PASSAGES:
            chosen.append((r["doc_id"],))
            total += r["size"]
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(0)):
                x, firsts = passages(data, offsets)
                bags = [bag.tobytes() for bag in np.split(x, firsts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, end - first), batch.column(2).slice(first, end - first), pa.array(bags, pa.binary())],
                    ["doc_id", "label", "bag"],
                )

    bound_batches(docs.sparkSession)
    encoded = sample.join(F.broadcast(chosen), "doc_id").select("text", "doc_id", "label").mapInArrow(encode, "doc_id long, label int, bag binary")
    rows = sorted(encoded.toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["bag"]))
    y = np.array([float(r["label"] == 1) for r in rows])
    if not 0 < y.sum() < len(y):
        return {"share": np.float32(y.mean() if len(y) else 0.5)}
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    firsts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    return fit(np.concatenate(bags).astype(np.float64), firsts, y)


def score(docs: DataFrame, model: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text", least: float = 0.7) -> DataFrame:
    """Per row: ``doc_id, score, predicted`` and ``top_passage``, the most attended one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1)):
                x, firsts = passages(data, offsets)
                if "share" in model:
                    p, top = np.full(end - first, float(model["share"])), np.zeros(end - first, np.int64)
                else:
                    f = _forward(model, x, firsts)
                    p = f["p"].astype(np.float64)
                    top = np.array([b.argmax() for b in np.split(f["e"], firsts[1:])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(p), pa.array((p >= least).astype(np.int32)), pa.array(top, pa.int64())],
                    ["doc_id", "score", "predicted", "top_passage"],
                )

    bound_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, predicted int, top_passage long")
