"""Language ID by multilingual mixture inference.

A language is a table of log-probabilities of hashed byte trigrams of words,
counted over all training documents. A document is a mixture of languages: the
likelihood of each of its words under each language comes from the word's
trigrams, and expectation-maximisation estimates the proportions. The language
set is chosen by penalised likelihood: another language must raise the
log-likelihood by more than half the logarithm of the number of words.

Counting is one pass whose tasks each return at most ``languages x BUCKETS``
sums; what reaches the driver is that table, whatever the corpus size. Scoring
is one pass over Arrow buffers in bounded chunks, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, chunks, fresh
from .words import PART, parts

BUCKETS = 1 << 16
#: Shares that change less from one round to the next have converged; the rounds of a document end in any case.
STILL, ROUNDS = 1e-4, 500
UNKNOWN = "und"


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, document, is first of its word) of every letter byte.

    A trigram is a letter byte with its neighbours; a neighbour that is not a
    letter, or lies in another document, counts as a blank.
    """
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    clean = np.where(letter, data, 32).astype(np.uint32)
    padded = np.concatenate([[np.uint32(32)], clean, [np.uint32(32)]])
    before, after = padded[:-2].copy(), padded[2:].copy()
    sizes = np.diff(offsets)
    full = sizes > 0
    before[offsets[:-1][full]] = 32
    after[offsets[1:][full] - 1] = 32
    at = np.flatnonzero(letter)
    code = (before[at] << 16 | clean[at] << 8 | after[at]) * np.uint32(2654435761) >> np.uint32(16)
    return code.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)[at], before[at] == 32


def _in_parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Several texts as they are, a long one in parts that end between words."""
    if len(offsets) > 2 or len(data) <= PART:
        yield data, offsets
    else:
        for a, b in parts(data):
            yield data[a:b], np.array([0, b - a])


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities by bucket and language) from all rows with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for first, end, data, offsets in chunks(batch.column(0), lower=True):
                kinds = sorted(set(names[first:end]))
                rank = np.array([kinds.index(x) for x in names[first:end]])
                for data, offsets in _in_parts(data, offsets):
                    code, doc, _ = trigrams(data, offsets)
                    found = np.bincount(rank[doc] * BUCKETS + code, minlength=len(kinds) * BUCKETS).reshape(-1, BUCKETS)
                    for k, row in zip(kinds, found, strict=True):
                        sums[k] = sums.get(k, 0) + row
        for k, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k] * max(1, len(at))), pa.array(at if len(at) else [0], pa.int32()), pa.array(row[at] if len(at) else [0], pa.int64())],
                ["lang", "bucket", "n"],
            )

    bound_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    table = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(table["lang"].to_pylist()))
    counts = np.zeros((BUCKETS, len(names)))
    column = np.array([names.index(x) for x in table["lang"].to_pylist()], np.int64)
    counts[table["bucket"].to_numpy(), column] = table["n"].to_numpy()
    counts += 0.1
    return names, np.log(counts / counts.sum(0)).astype(np.float32) if names else counts.astype(np.float32)


def _em(weight: np.ndarray, count: np.ndarray, doc: np.ndarray, starts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods, from word likelihoods that are scaled by word, and the words' counts.

    Rounds go on for the documents whose shares still change by more than ``STILL``.
    """
    share = share.copy()
    sizes = np.add.reduceat(count, starts)
    live, w, c, d, s = np.arange(len(starts)), weight, count[:, None], doc, starts
    for _ in range(ROUNDS):
        joint = w * share[live][d]
        joint *= c / joint.sum(1, keepdims=True)
        new = np.add.reduceat(joint, s, axis=0) / sizes[live][:, None]
        moving = np.abs(new - share[live]).max(1) > STILL
        share[live] = new
        if not moving.any():
            break
        if moving.mean() < 0.7:
            inside = moving[d]
            w, c, d = w[inside], c[inside], (np.cumsum(moving) - 1)[d[inside]]
            live = live[moving]
            s = np.flatnonzero(np.diff(d, prepend=-1))
    return share, np.add.reduceat(count * np.log((weight * share[doc]).sum(1)), starts)


def infer(words: np.ndarray, doc: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(language shares by document, the index of its main language).

    ``words`` holds log-likelihoods by word and language, ``doc`` the documents 0,
    1, 2 ... of the words in order, none without a word, ``count`` how often each
    word stands there. Sets are tried by size, with the languages in the order of
    their shares among all; any size is possible.
    """
    count = np.ones(len(doc)) if count is None else count
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    n_docs, n_langs = len(starts), words.shape[1]
    scaled = np.maximum(words - words.max(1, keepdims=True), -30.0)
    weight = np.exp(scaled)
    single = np.add.reduceat(scaled * count[:, None], starts, axis=0)
    main = single.argmax(1)
    share = np.zeros((n_docs, n_langs))
    share[np.arange(n_docs), main] = 1
    if n_langs == 1:
        return share, main
    price = 0.5 * np.log(np.add.reduceat(count, starts) + 1)
    chosen = single.max(1)
    full, likelihood = _em(weight, count, doc, starts, np.full((n_docs, n_langs), 1 / n_langs))
    mixed = np.flatnonzero(likelihood - price > chosen)
    if not len(mixed):
        return share, main
    inside = np.isin(doc, mixed)
    weight, count, starts = weight[inside], count[inside], np.flatnonzero(np.diff(doc[inside], prepend=-1))
    doc = np.searchsorted(mixed, doc[inside])
    order = np.argsort(-full[mixed], axis=1, kind="stable")
    chosen, price = chosen[mixed].copy(), price[mixed]
    for k in range(2, n_langs + 1):
        first = np.zeros((len(mixed), n_langs))
        np.put_along_axis(first, order[:, :k], 1 / k, axis=1)
        own, likelihood = _em(weight, count, doc, starts, first)
        better = likelihood - price * (k - 1) > chosen
        chosen[better] = (likelihood - price * (k - 1))[better]
        share[mixed[better]] = own[better]
    return share, share.argmax(1)


def word_likelihoods(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(log-likelihoods by word and language, document of each word, counts); equal words of a long text are one with a count."""

    def of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, doc, opens = trigrams(data, offsets)
        at = np.flatnonzero(opens)
        return (np.add.reduceat(table[code], at, axis=0) if len(at) else np.zeros((0, table.shape[1]), table.dtype)), doc[at]

    if len(offsets) > 2 or len(data) <= PART:
        return *of(data, offsets), None
    rows, counts = np.zeros((0, table.shape[1]), table.dtype), np.zeros(0)
    for piece in _in_parts(data, offsets):
        more = of(*piece)[0]
        rows, at = np.unique(np.concatenate([rows, more]), axis=0, return_inverse=True)
        counts = np.bincount(at.ravel(), np.concatenate([counts, np.ones(len(more))]), len(rows))
    return rows, np.zeros(len(rows), np.int64), counts


def _identified(text: pa.Array, has_letter: pa.Array, model: tuple[list[str], np.ndarray]) -> Iterator[tuple[int, int, list[str], np.ndarray, list[str]]]:
    """(first row, end row, main language, its share, all languages) by chunk."""
    names, table = model
    ok = pc.fill_null(has_letter, False).to_numpy(zero_copy_only=False)
    for first, end, data, offsets in chunks(text, lower=True):
        n = end - first
        lang, score, sets = [UNKNOWN] * n, np.zeros(n), [""] * n
        words, doc, count = word_likelihoods(data, offsets, table)
        if len(words) and names:
            rows, dense = np.unique(doc, return_inverse=True)
            share, main = infer(words.astype(np.float64), dense, count)
            for r, s, m in zip(rows.tolist(), share, main.tolist(), strict=True):
                if ok[first + r]:
                    lang[r], score[r] = names[m], min(1.0, float(s[m]))
                    sets[r] = ",".join(f"{names[k]}:{s[k]:.3f}" for k in np.argsort(-s, kind="stable") if s[k] >= 5e-4)
        yield first, end, lang, score, sets


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, lang_pred, score, languages``.

    ``score`` is the share of ``lang_pred`` in the chosen mixture; ``languages``
    lists the set as name:share. A text that is null or has no letter, and any
    text where no language was learned, gets ``und`` and 0. Repeated rows are
    judged each; an empty table gives no rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, lang, score, sets in _identified(batch.column(1), batch.column(2), model):
                ids = batch.column(0).slice(first, end - first)
                yield pa.RecordBatch.from_arrays([ids, pa.array(lang), pa.array(score), pa.array(sets)], ["doc_id", "lang_pred", "score", "languages"])

    bound_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(text).rlike(r"\p{L}").alias("ok"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, languages string")


def keep_identified(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """The rows, with all their columns, in which a language is found: mixtures too, whatever their shares."""
    at, n = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, lang, _, _ in _identified(batch.column(at), batch.column(n), model):
                keep = pa.array([k != UNKNOWN for k in lang], pa.bool_())
                part = batch.slice(first, end - first).filter(keep)
                yield pa.RecordBatch.from_arrays(part.columns[:n], part.schema.names[:n])

    bound_batches(docs.sparkSession)
    flagged = docs.select("*", F.col(text).rlike(r"\p{L}").alias(*fresh(docs, "has_letter")))
    return flagged.mapInArrow(run, docs.schema)
