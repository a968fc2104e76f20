"""Embedding near-dedup by random-hyperplane sign hashing.

Equal vectors of a label form a class with a count and are compared once.
Classes are hashed in several tables; classes that share a table's signs meet in
a bucket, first with nothing but a sketch of 128 further signs each. Only classes
whose sketch is close to that of another of the bucket are exchanged with their
vectors, and exact cosines in double precision decide. A pair that meets in
several tables counts in the first alone, which is seen from the two signatures.
Buckets return sums per class and one link from each class to the smallest of
its linked group within the bucket, never pairs.

The number of sign bits follows the number of classes, and the number of tables
follows the bits, so that a pair at the cosine bound is missed with a
probability below ``MISS`` at every size; the sketches add at most ``SKETCH_MISS``
to that. Large buckets are worked on as pairs of blocks of at most ``BLOCK``
classes, so no bucket is one task's load.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null label or id, link with nothing: 0 links, own
id, kept. Vectors of different lengths are not compared. Repeated rows count as
other vectors. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialize
from .components import connected_components

MISS, BLOCK, BUCKET = 1e-6, 1024, 128
SKETCH, SKETCH_MISS = 128, 1e-9
NEAR, LINKS = ["bucket", "low", "high", "table", "rep", "own"], ["rep", "links", "root"]


def tables_for(classes: int, cosine: float) -> tuple[int, int]:
    """(sign bits by table, tables) for so many classes of one label."""
    bits = min(24, max(4, round(math.log2(max(1, classes) / BUCKET + 1)) + 1))
    hit = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-hit))


def sketch_reach(cosine: float) -> int:
    """How many of the sketches' signs may differ, so that a pair at the bound differs in more with a probability below ``SKETCH_MISS``."""
    p = math.acos(cosine) / math.pi
    beyond, most = 1.0, -1
    while most < SKETCH and beyond >= SKETCH_MISS:
        most += 1
        beyond = math.fsum(math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k) for k in range(most + 1, SKETCH + 1))
    return most


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([dim, bits, tables]).normal(size=(dim, bits * tables))


def _near_in_sketch(a: np.ndarray, b: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sketches of ``a`` are within ``most`` signs of one of ``b``, and the other way round; without ``b``, of another of ``a``."""
    other = a if b is None else b
    differ = sum(np.bitwise_count(a[:, None, k] ^ other[None, :, k]).astype(np.int16) for k in range(a.shape[1]))
    near = differ <= most
    if b is None:
        np.fill_diagonal(near, False)
    return near.any(1), near.any(0)


def _bucket_links(ids: np.ndarray, n: np.ndarray, x: np.ndarray, signs: np.ndarray, table: int, side: np.ndarray | None, cosine: float) -> tuple[np.ndarray, ...]:
    """Links within a bucket, or between two blocks of it, first met in this table."""
    close = x @ x.T >= cosine
    for t in range(table):
        close &= signs[:, t][:, None] != signs[:, t][None, :]
    np.fill_diagonal(close, False)
    if side is not None:
        close &= side[:, None] != side[None, :]
    linked = np.flatnonzero(close.any(1))
    close, ids, n = close[np.ix_(linked, linked)], ids[linked], n[linked]
    root, last = ids.copy(), None
    big = np.iinfo(np.int64).max
    while len(ids) and (last is None or (root != last).any()):
        last = root
        root = np.minimum(root, np.where(close, root[None, :], big).min(1))
    return ids, close @ n if len(ids) else ids, root


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each group, from rows in order of their first ``keys`` columns."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        opens = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            key = batch.column(k).to_numpy()
            opens[1:] |= key[1:] != key[:-1]
        edges = [0, *np.flatnonzero(opens).tolist()]
        for a, b in pairwise(edges):
            yield batch.slice(a, b - a)
        held = batch.slice(edges[-1])
    if held is not None:
        yield held


def _batched(rows: Iterator[tuple[np.ndarray, ...]], names: list[str], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The columns of many small results, some thousand rows at a time."""
    kept, n = [], 0
    for row in rows:
        if len(row[0]):
            kept.append(row)
            n += len(row[0])
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept, strict=True)], names)
            kept, n = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*kept, strict=True)], names)


def embedding_near_dedup(df: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    bound_batches(df.sparkSession)
    v = F.col("embedding")
    rows = df.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<float>").alias("embedding"), F.col(label).alias("label")
    )
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    # A sum of 0.0 makes -0.0 and 0.0 one value, so that equal vectors have one key.
    rows = rows.withColumn("key", F.when(F.coalesce(usable, F.lit(False)), F.transform(v, lambda x: x + F.lit(0.0).cast("float"))))
    # 128 bits stand for label and vector where results go back to rows, so that vectors are exchanged for the classes only.
    names = [F.xxhash64("label", "key").alias("k1"), F.xxhash64(F.lit(1), "label", "key").alias("k2")]
    classes = rows.where("key is not null").groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.select("*", *names), "vectors")
    most = classes.groupBy("label", F.size("key").alias("dim")).count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(most, cosine)

    @F.pandas_udf("signs array<int>, s1 long, s2 long")
    def hashed(keys: pd.Series) -> pd.DataFrame:
        out: list = [None] * len(keys)
        sketch = np.zeros((len(keys), 2), np.int64)
        sizes = keys.map(len).to_numpy()
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            x = np.stack(keys.iloc[at].to_numpy()).astype(np.float64)
            signs = (x @ planes(int(dim), bits, tables) > 0).reshape(len(at), tables, bits)
            for i, row in zip(at.tolist(), signs @ (1 << np.arange(bits)), strict=True):
                out[i] = row.astype(np.int32)
            sketch[at] = np.packbits(x @ planes(int(dim), SKETCH, 1) > 0, axis=1).view(np.int64)
        return pd.DataFrame({"signs": pd.Series(out, dtype=object), "s1": sketch[:, 0], "s2": sketch[:, 1]})

    signed = materialize(classes.select("*", hashed("key").alias("h")).select(*classes.columns, "h.*"), "signs")
    discard(classes)
    # A bucket goes by a hash until vectors meet: two that collide share sketches in vain, no more.
    bucket = F.xxhash64("label", F.size("key"), "table", "sign").alias("bucket")
    met = signed.select("label", "key", "rep", "s1", "s2", F.posexplode("signs").alias("table", "sign")).select(bucket, "table", "rep", "s1", "s2")
    counts = met.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = met.join(counts, "bucket").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A class goes to the pairs of its block with each block of the bucket.
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "table", "rep", "own", "s1", "s2")
    group = ["bucket", "low", "high"]
    reach = sketch_reach(cosine)

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[np.ndarray, ...]]:
            for part in _groups(batches, 3):
                low, high, own = part["low"][0].as_py(), part["high"][0].as_py(), part["own"].to_numpy()
                sketch = np.stack([part["s1"].to_numpy(), part["s2"].to_numpy()], 1).view(np.uint64)
                if low == high:
                    keep = _near_in_sketch(sketch, None, reach)[0]
                else:
                    first = own == low
                    keep = np.zeros(len(own), bool)
                    keep[first], keep[~first] = _near_in_sketch(sketch[first], sketch[~first], reach)
                yield tuple(part[c].to_numpy()[keep] for c in NEAR)

        return _batched(rows(), NEAR)

    # Dealt by block pair: dealt by bucket alone, a large bucket would be one task.
    near = placed.repartition(*group).sortWithinPartitions(*group).mapInArrow(plausible, "bucket long, low int, high int, table int, rep long, own int")
    group = [*group, "dim", "of"]
    vectors = signed.select("rep", "n", "key", "signs", F.size("key").alias("dim"), F.xxhash64(F.lit(1), "label").alias("of"))
    near = near.join(vectors, "rep").select(*group, "table", "rep", "own", "n", "key", "signs").repartition(*group).sortWithinPartitions(*group)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[np.ndarray, ...]]:
            for part in _groups(batches, 5):
                if part.num_rows == 1:
                    continue
                x, signs = (part[c].flatten().to_numpy().reshape(part.num_rows, -1) for c in ("key", "signs"))
                x = x.astype(np.float64)
                x /= np.sqrt((x * x).sum(1))[:, None]
                apart = part["low"][0].as_py() != part["high"][0].as_py()
                yield _bucket_links(
                    part["rep"].to_numpy(), part["n"].to_numpy(), x, signs, part["table"][0].as_py(), part["own"].to_numpy() if apart else None, cosine
                )

        return _batched(rows(), LINKS)

    found = materialize(near.mapInArrow(links, "rep long, links long, root long"), "found")
    total = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("rep <> root"), "rep", "root").withColumnRenamed("node", "rep")
    result = signed.select("rep", "n", "k1", "k2").join(total, "rep", "left").join(parts, "rep", "left")
    result = result.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    hashes = [F.when(F.col("key").isNotNull(), k).alias(f"k{i}") for i, k in enumerate(names, 1)]
    out = rows.select("vec_id", *hashes).join(result, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
