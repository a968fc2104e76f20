"""MinHash near-dedup by a multi-index Hamming join.

A document's shingle set is sketched by ``CHUNKS * SYMBOLS`` min-hashes of 16
bits. The signature is split into chunks by the pigeonhole principle: two
signatures that differ in at most ``CHUNKS * (ERRORS + 1) - 1`` symbols have a
chunk with at most ``ERRORS`` wrong symbols. Each chunk is therefore indexed
once for every choice of the symbols left out, and all pairs within that
distance meet under a key. Candidates are confirmed on the full shingle sets.

Documents with equal sets form a class and are compared once. A key's classes
are first confirmed against its smallest class alone, which links most of a
group of near copies with as many candidates as members. Only classes that are
still apart under a key are compared further: the minor ones, outside the key's
largest component, against all others there. Where that is little work, or the
minor classes are few, it is done as pairs, which sizes and smallest hashes prune
before texts are fetched. Else blocks of minor classes meet blocks of all classes,
each bounded in classes and in shingles, and return a forest of confirmed links.
So every candidate pair is either inside a component or confirmed itself, and no
group is expanded into all its pairs.

Defined cases: null and blank texts have no shingles and link with nothing;
texts shorter than a shingle are one shingle; repeated rows have equal sets and
so share a class; rows that share an id but not a set are in one component, as
the id is one document, unless ``by_id`` is false; null ids link with nothing; an
empty table gives no rows; other columns are ignored, or kept by
``first_of_groups``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, chunks, discard, fresh, materialize
from .components import connected_components
from .words import PART, all_hashes, mix, runs, word_hashes

CHUNKS, SYMBOLS, ERRORS = 6, 4, 1
SIZE = CHUNKS * SYMBOLS
#: All pairs up to this symbol distance are found.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: The smallest shingle hashes of a set that bound a similarity from above.
BOTTOM = 128
#: A key with more pairs than this to compare, and more minor classes than that, is worked on in blocks ...
WIDE, MINOR = 1024, 4
#: ... of about so many classes, or fewer with so many shingles in all; strips of a block's shingles are compared at once.
BLOCK, WEIGHT, STRIP = 768, 1 << 20, 4096
#: So many rows may be broadcast; more are joined by a shuffle.
FEW = 400_000
_ODD = np.random.default_rng(11).integers(0, 1 << 63, (2, SIZE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    if len(offsets) == 2 and len(data) > PART:
        words = all_hashes(data, lower=True)
        firsts = np.array([0, len(words)])
    else:
        words, _, _, firsts = word_hashes(data, offsets, lower=True)
    hashed = runs(words, k)
    out = []
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(hashed[a : b - k + 1]))
        elif b > a:
            out.append(runs(words[a:b], b - a)[:1])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        h = (s[at : at + 4096, None] ^ _ODD[1]) * _ODD[0]
        np.minimum(least, (h ^ (h >> np.uint64(32))).min(0), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.int32)


def sketches(docs: DataFrame, shingle: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, row, n, s1, s2, signature``: a key of id and text, set size, a 128-bit set hash, the min-hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(2)):
                sets = shingle_sets(data, offsets, shingle)
                n = pa.array([len(s) for s in sets], pa.int64())
                ids = [np.array([op(mix(s ^ c)) if len(s) else 0 for s in sets], np.uint64).view(np.int64) for op, c in ((np.sum, np.uint64(1)), (np.bitwise_xor.reduce, np.uint64(2)))]
                flat = np.concatenate([signature(s) for s in sets])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SIZE), pa.int32()), pa.array(flat, pa.int32()))
                own = [batch.column(c).slice(first, end - first) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, n, pa.array(ids[0]), pa.array(ids[1]), lists], ["doc_id", "row", "n", "s1", "s2", "signature"])

    bound_batches(docs.sparkSession)
    return _rows(docs, doc_id, text).mapInArrow(run, "doc_id long, row long, n long, s1 long, s2 long, signature array<int>")


def _row_key(doc_id: str, text: str) -> list[Column]:
    i, t = F.col(doc_id).cast("long"), F.col(text).cast("string")
    return [i, F.xxhash64(i, t)]


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    i, row = _row_key(doc_id, text)
    return docs.select(i.alias("doc_id"), row.alias("row"), F.col(text).cast("string").alias("text"))


def _keys(signature: str = "signature"):
    """One key for each chunk and choice of a symbol left out."""
    at = lambda c, k: F.col(signature)[c * SYMBOLS + k]
    return F.explode(
        F.array(
            *[
                F.xxhash64(F.lit(c * SYMBOLS + gone), *[at(c, k) for k in range(SYMBOLS) if k != gone])
                for c in range(CHUNKS)
                for gone in range(SYMBOLS)
            ]
        )
    )


def _with_bottoms(texts: DataFrame, shingle: int) -> DataFrame:
    """Adds ``bottom``: the smallest hashes of the text's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1)):
                least = [x[:BOTTOM].view(np.int64) ^ np.int64(-(1 << 63)) for x in shingle_sets(data, offsets, shingle)]
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(least, pa.list_(pa.int64()))], ["cid", "text", "bottom"])

    return texts.select("cid", "text").mapInArrow(run, "cid long, text string, bottom array<long>")


def _may_reach(percent: int) -> Column:
    """False only for pairs ``na, ba, nb, bb`` whose smallest hashes prove the similarity out of reach.

    A hash of one side that is not beyond the other's largest stored one, and is not
    stored there, is not in the other set at all.
    """

    def in_both(own: str, other: str, n_own: str, n_other: str) -> Column:
        most = F.element_at(other, -1)
        lacking = F.filter(F.array_except(own, other), lambda x: (F.col(n_other) <= BOTTOM) | (x <= most))
        return F.col(n_own) - F.size(lacking)

    common = F.least(in_both("ba", "bb", "na", "nb"), in_both("bb", "ba", "nb", "na"))
    return 100 * common >= percent * (F.col("na") + F.col("nb") - common)


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose shingle sets have 100 * common >= percent * united."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # sets of recent documents, bounded by bytes
        held = 0

        def of(doc: int, text: pa.Scalar) -> np.ndarray:
            nonlocal held
            if doc not in known:
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                found = shingle_sets(raw, np.array([0, len(raw)]), shingle)[0]
                if held > 32 << 20:
                    known.clear()
                    held = 0
                known[doc] = found
                held += found.nbytes + 200
            return known[doc]

        for batch in batches:
            good = []
            ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True)
            for a, b, x, y in ids:
                sx, sy = of(a, x), of(b, y)
                common = len(sx) + len(sy) - len(np.union1d(sx, sy))
                good.append(100 * common >= percent * (len(sx) + len(sy) - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    both = pairs.join(texts.withColumnsRenamed({"cid": "a", "text": "x"}), "a").join(texts.withColumnsRenamed({"cid": "b", "text": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _block_links(pdf: pd.DataFrame, shingle: int, percent: int) -> pd.DataFrame:
    """Confirmed links between a block of minor classes and a block of all classes of a key, as a forest.

    All intersections come from products of incidence matrices, in strips of
    shingles that two or more of the texts have.
    """
    raw = [np.frombuffer(t.encode(), np.uint8) for t in pdf["text"]]
    sets = [shingle_sets(r, np.array([0, len(r)]), shingle)[0] for r in raw]
    n, minor = np.array([len(x) for x in sets]), pdf["minor"].to_numpy(bool)
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[at]
    row = np.repeat(np.arange(len(sets)), n)
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((int(minor.sum()), int((~minor).sum())), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for first in range(0, width, STRIP):
        a, b = np.searchsorted(column, [first, first + STRIP])
        strip = np.zeros((len(sets), min(STRIP, width - first)), np.float32)
        strip[row[a:b], column[a:b] - first] = 1
        common += strip[minor] @ strip[~minor].T
    close = 100 * common >= percent * (n[minor][:, None] + n[~minor][None, :] - common)
    part, ids = pdf["part"].to_numpy(), pdf["cid"].to_numpy()
    close &= part[minor][:, None] != part[~minor][None, :]
    rows, columns = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
    close, a, b = close[np.ix_(rows, columns)], ids[minor][rows], ids[~minor][columns]
    left, right, last, big = a.copy(), b.copy(), None, np.iinfo(np.int64).max
    while len(a) and (last is None or (left != last).any()):
        last = left
        right = np.minimum(right, np.where(close, left[:, None], big).min(0))
        left = np.minimum(left, np.where(close, right[None, :], big).min(1))
    links = pd.DataFrame({"a": np.concatenate([a, b]), "b": np.concatenate([left, right])})
    return links[links["a"] != links["b"]].drop_duplicates()


def _small(rows: DataFrame) -> DataFrame:
    """``rows``, to be broadcast if a count shows that they are few."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def placed_in_blocks(open_: DataFrame) -> DataFrame:
    """``key, mb, ab, cid, part, minor``: every minor class once for each block of all classes, and the other way round."""
    blocks = lambda n, weight: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(weight) / WEIGHT)).cast("int")
    counted = open_.withColumns({"all_blocks": blocks("total", "weight"), "minor_blocks": blocks("minors", "minor_weight")})
    block = lambda salt, n: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    everyone = counted.select("key", each("minor_blocks").alias("mb"), block(0, "all_blocks").alias("ab"), "cid", "part", F.lit(False).alias("minor"))
    minor = counted.where("part <> major")
    minor = minor.select("key", block(1, "minor_blocks").alias("mb"), each("all_blocks").alias("ab"), "cid", "part", F.lit(True).alias("minor"))
    return everyone.unionByName(minor)


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", by_id: bool = True) -> DataFrame:
    """One row per document: ``doc_id, row, n_shingles, first``.

    ``first`` has the smallest ``doc_id`` of the document's group and the smallest
    ``row``, a key of id and text, of that id there; it is null where nothing links.
    """
    sketched = materialize(sketches(docs, shingle, doc_id, text), "sketches")
    known = sketched.where("n > 0 and doc_id is not null")
    classes = known.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "row")).alias("one"), F.first("signature").alias("signature"))
    # Stored with a number each: that is what a class is called from here on.
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("cid", "n", _keys().alias("key"))
    # Key tables are stored: both sides of a join are then plain shuffles, which adaptive execution can split.
    centres = keyed.groupBy("key").agg(F.min(F.struct("cid", "n")).alias("centre"), F.max("cid").alias("most")).where("centre.cid < most")
    centres = materialize(centres.select("key", F.col("centre.cid").alias("centre"), F.col("centre.n").alias("nb")), "centres")
    live = materialize(keyed.join(centres, "key"), "keys")
    wanted = classes.join(live.select("cid").distinct(), "cid", "left_semi").select("one.doc_id", "one.row", "cid")
    # Equal rows have equal keys: one of them is enough here.
    texts = _rows(docs, doc_id, text).join(_small(wanted), ["doc_id", "row"]).groupBy("cid").agg(F.first("text").alias("text"))
    stored_texts = texts = materialize(_with_bottoms(texts, shingle), "texts")
    bottoms = texts.select("cid", "bottom")
    texts = texts.select("cid", "text")

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs ``a, na, b, nb`` that the set sizes and the smallest hashes allow; none that is similar is lost."""
        a, b = (bottoms.withColumnsRenamed({"cid": k, "bottom": f"b{k}"}) for k in "ab")
        pairs = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).distinct()
        return pairs.join(a, "a").join(b, "b").where(_may_reach(percent)).select("a", "b")

    stars = live.where("cid <> centre").select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("centre").alias("b"), "nb")
    stars = materialize(plausible(stars), "stars")
    first_links = materialize(confirm(stars, texts, shingle, percent), "linked")
    parts = connected_components(first_links)

    # Keys under which several components, or loose classes, meet.
    labelled = live.join(parts.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", "n", F.coalesce("component", "cid").alias("part"))
    sizes = labelled.groupBy("key", "part").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    largest = F.max_by(F.struct("part", "size", "weight"), F.struct("size", "part")).alias("top")
    major = sizes.groupBy("key").agg(largest, F.count("*").alias("parts"), F.sum("size").alias("total"), F.sum("weight").alias("weight")).where("parts > 1")
    major = materialize(
        major.select(
            "key", F.col("top.part").alias("major"), "total", "weight", (F.col("total") - F.col("top.size")).alias("minors"),
            (F.col("weight") - F.col("top.weight")).alias("minor_weight"),
        ),
        "major",
    )
    open_ = materialize(labelled.join(major, "key"), "open")
    wide = (F.col("minors") * F.col("total") > WIDE) & (F.col("minors") > MINOR)

    placed = placed_in_blocks(open_.where(wide)).join(texts, "cid")
    in_blocks = placed.groupBy("key", "mb", "ab").applyInPandas(lambda pdf: _block_links(pdf, shingle, percent), "a long, b long")
    in_blocks = materialize(in_blocks, "blocks")

    narrow = open_.where(~wide).select("key", "cid", "n", "part", "major")
    minor = narrow.where("part <> major").select("key", F.col("cid").alias("x"), F.col("part").alias("px"), F.col("n").alias("nx"))
    apart = (F.col("px") != F.col("part")) & ((F.col("part") == F.col("major")) | (F.col("x") < F.col("cid")))
    more = minor.join(narrow, "key").where(apart)
    first = F.col("x") < F.col("cid")
    more = more.select(
        F.greatest("x", "cid").alias("a"), F.when(first, F.col("n")).otherwise(F.col("nx")).alias("na"),
        F.least("x", "cid").alias("b"), F.when(first, F.col("nx")).otherwise(F.col("n")).alias("nb"),
    )
    more = materialize(plausible(more.join(stars, ["a", "b"], "left_anti")), "more")
    linked = first_links.unionByName(confirm(more, texts, shingle, percent)).unionByName(in_blocks)
    if by_id:
        linked = linked.unionByName(_same_id(known, classes))
    parts = connected_components(linked).withColumnRenamed("node", "cid")
    discard(live, centres, stars, more, major, open_, in_blocks, stored_texts)

    grouped = classes.join(parts, "cid").select("n", "s1", "s2", "component", "one")
    firsts = materialize(grouped.groupBy("component").agg(F.min("one").alias("first")), "firsts")
    linked_classes = materialize(grouped.join(firsts, "component").select("n", "s1", "s2", "first"), "groups")
    alone = classes.join(parts, "cid", "left_anti").select("n", "s1", "s2", F.col("one").alias("first"))
    named = materialize(linked_classes.unionByName(alone), "named")
    rows = sketched.select("doc_id", "row", "n", "s1", "s2")
    out = rows.join(named, ["n", "s1", "s2"], "left")
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("first")).alias("first"))


def _same_id(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of an id that has several."""
    sets = F.struct("n", "s1", "s2")
    several = known.groupBy("doc_id").agg(F.min(sets).alias("lo"), F.max(sets).alias("hi")).where("lo <> hi").select("doc_id")
    several = materialize(several, "several-sets")
    rows = known.select("doc_id", "n", "s1", "s2").join(_small(several), "doc_id", "left_semi")
    rows = rows.join(classes.select("n", "s1", "s2", "cid"), ["n", "s1", "s2"]).select("doc_id", "cid").distinct()
    least = rows.groupBy("doc_id").agg(F.min("cid").alias("b"))
    return rows.join(least, "doc_id").where("cid <> b").select(F.col("cid").alias("a"), "b")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    out = near_groups(docs, shingle, percent, doc_id, text)
    component = F.coalesce("first.doc_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def first_of_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, of which one stays for each group of near duplicates.

    It is that with the smallest id, then the smallest key of id and text; of rows
    equal in both, the smallest as JSON. Rows that share an id but not a text are
    judged apart. Rows that link with nothing stay.
    """
    found = near_groups(docs, shingle, percent, doc_id, text, by_id=False)
    i, k = fresh(docs, "id", "row")
    stays = F.col("first").isNull() | (F.col("first") == F.struct("doc_id", "row"))
    found = materialize(found.select(F.col("doc_id").alias(i), F.col("row").alias(k), stays.alias("stays"), (F.col("n_shingles") > 0).alias("linkable")), "verdict")
    gone = found.where("not stays").select(i, k).distinct()
    twice = found.where(F.col("stays") & F.col("linkable") & F.col(i).isNotNull()).groupBy(i, k).agg(F.count("*").alias("c")).where("c > 1").select(i, k)
    twice = materialize(twice, "twice")
    own, row = _row_key(doc_id, text)
    rows = docs.select("*", own.alias(i), row.alias(k)).join(_small(gone), [i, k], "left_anti")
    names = [F.col(f"`{c}`") for c in docs.columns]
    if not twice.limit(1).count():
        return rows.select(*names)
    whole = F.struct(*names)
    once = rows.join(_small(twice), [i, k], "left_semi").groupBy(i, k).agg(F.min_by(whole, F.to_json(whole)).alias("one"))
    return rows.join(_small(twice), [i, k], "left_anti").select(*names).unionByName(once.select(*[F.col("one")[c].alias(c) for c in docs.columns]))
