"""Quality rules (8): hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are compared: the
*raw* one is counted over every document, the *trusted* one over documents
labelled good.  A document's score is the mean log ratio of its n-grams
(length-normalised); every document is decided by one threshold.

* Counting: each task adds up fixed-size bucket arrays and emits one row per
  bucket; Spark sums them.  What reaches the driver is BUCKETS rows.
* Trusted rows: at most `max_labels` labelled rows (documented bound, the
  smallest hashes of doc_id).  Even hashes fit the trusted multinomial, odd
  ones (good and bad) place the threshold, so it is chosen on held-out rows.
* Weights are fixed-point integers: sums do not depend on how rows are
  batched, so reruns agree bit by bit.

Cases: null text is an empty text (no words, base_failed); no labelled rows:
the model passes every document; repeated rows are decided alike; other
columns of the inputs are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import SPACE, U64, TextBlock, doc_of, grams, inside, mix, span_hash, text_blocks

BITS = 14
BUCKETS = 1 << BITS
SCALE = 1 << 16
PRIOR_MASS = 1000.0
MAX_LABELS = 40_000

MIN_WORDS = 50
# The symbols that count as markup noise.
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True

DIGEST = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, base_failed boolean, kept boolean, llr double")


def _word_hashes(blk: TextBlock):
    ws, we, first = blk.words()
    return ws, we, first, span_hash(blk.data, ws, we)


def _buckets(wh: np.ndarray, first: np.ndarray):
    """Bucket of each unigram and of each in-document bigram (with its doc)."""
    shift = U64(64 - BITS)
    uni = (wh >> shift).astype(np.int64)
    ok = inside(first, 2, len(wh))
    bi = (grams(wh, 2) >> shift).astype(np.int64)[ok]
    doc = doc_of(first)
    return uni, doc, bi, doc[:len(ok)][ok]


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw = np.zeros(BUCKETS, dtype=np.int64)
    good = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        trusted = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
        for blk in text_blocks(batch.column("text")):
            _, _, first, wh = _word_hashes(blk)
            uni, ud, bi, bd = _buckets(wh, first)
            t = trusted[blk.row0:blk.row0 + blk.n]
            for bucket, doc in ((uni, ud), (bi, bd)):
                raw += np.bincount(bucket, minlength=BUCKETS)
                if t.any():
                    good += np.bincount(bucket[t[doc]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(good[some])],
        names=["bucket", "n_raw", "n_good"])


def base_metrics(blk: TextBlock, parts) -> dict[str, np.ndarray]:
    """The five base counts of each document of a block."""
    ws, we, first, wh = parts
    data = blk.data
    n_words = np.diff(first)
    solid = ~SPACE[data]
    out = {"n_words": n_words,
           "word_chars": blk.per_doc(solid & ((data & 0xC0) != 0x80)),
           "n_symbols": blk.per_doc(_SYMBOL[data])}

    # Lines that hold a word, against the distinct ones among them.
    nl = np.flatnonzero(data == 10)
    ls = np.sort(np.concatenate([blk.start, nl + 1]))
    le = np.sort(np.concatenate([nl, blk.end]))
    acc = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(solid, out=acc[1:])
    has = acc[le] > acc[np.minimum(ls, le)]
    ls, le = ls[has], le[has]
    doc = np.searchsorted(blk.start, ls, side="right") - 1
    key = mix(span_hash(data, ls, le) + (doc + 1).astype(U64) * U64(0xA0761D6478BD642F))
    _, where = np.unique(key, return_index=True)
    out["n_dup_lines"] = (np.bincount(doc, minlength=blk.n)
                          - np.bincount(doc[where], minlength=blk.n))

    # Words inside a three-word window that the text holds at least twice.
    again = np.zeros(len(wh), dtype=bool)
    ok = inside(first, 3, len(wh))
    if ok.any():
        at = np.flatnonzero(ok)
        wdoc = doc_of(first)
        key = mix(grams(wh, 3)[at] + (wdoc[at] + 1).astype(U64) * U64(0xA0761D6478BD642F))
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        rep = np.zeros(len(k), dtype=bool)
        rep[1:] |= same
        rep[:-1] |= same
        hit = at[order[rep]]
        for d in range(3):
            again[hit + d] = True
    acc = np.zeros(len(wh) + 1, dtype=np.int64)
    np.cumsum(again, out=acc[1:])
    out["n_repeat_words"] = acc[first[1:]] - acc[first[:-1]]
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * n_words)
    return out


def _doc_sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    acc = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=acc[1:])
    b = np.searchsorted(doc, np.arange(n + 1))
    return acc[b[1:]] - acc[b[:-1]]


def _score(blk: TextBlock, parts, weights: np.ndarray):
    """(sum of fixed-point weights, number of n-grams) of each document."""
    uni, ud, bi, bd = _buckets(parts[3], parts[2])
    total = _doc_sums(weights[uni], ud, blk.n) + _doc_sums(weights[bi], bd, blk.n)
    n = np.bincount(ud, minlength=blk.n) + np.bincount(bd, minlength=blk.n)
    return total, n


class Model:
    """Weights (fixed point) and the threshold (fixed point, per n-gram)."""

    def __init__(self, weights: np.ndarray, threshold: int | None):
        self.weights, self.threshold = weights, threshold

    def evaluate(self, column) -> dict[str, np.ndarray]:
        """Digest columns for each row of a text column."""
        parts_out: dict[str, list] = {}
        for blk in text_blocks(column):
            parts = _word_hashes(blk)
            m = base_metrics(blk, parts)
            total, n = _score(blk, parts, self.weights)
            passed = np.ones(blk.n, bool) if self.threshold is None else total >= self.threshold * n
            m["kept"] = ~m["base_failed"] & passed
            m["llr"] = total / np.maximum(n, 1) / SCALE
            for k, v in m.items():
                parts_out.setdefault(k, []).append(v)
        return {k: np.concatenate(v) for k, v in parts_out.items()}


def labelled_sample(labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """At most `max_labels` labelled rows: (doc_id, good, fit)."""
    h = F.xxhash64("doc_id")
    return (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
            .groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("quality"))
            .select("doc_id", (F.col("quality") == 1).alias("good"),
                    (F.pmod(h, F.lit(2)) == 0).alias("fit"), h.alias("h"))
            .orderBy("h", "doc_id").limit(max_labels).drop("h"))


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Fit both multinomials and place the threshold (three bounded results
    reach the driver: labelled ids, bucket sums, held-out scores)."""
    spark = docs.sparkSession
    rows = labelled_sample(labels, max_labels).collect()
    if not any(r.good and r.fit for r in rows):
        return Model(np.zeros(BUCKETS, dtype=np.int64), None)
    sample = F.broadcast(spark.createDataFrame(rows, "doc_id long, good boolean, fit boolean"))
    text = docs.select("doc_id", "text")

    marked = (text.join(sample.where("good AND fit").select("doc_id", F.lit(True).alias("t")),
                        "doc_id", "left")
              .select("text", F.coalesce("t", F.lit(False)).alias("trusted")))
    counts = (marked.mapInArrow(_count_task, "bucket int, n_raw long, n_good long")
              .groupBy("bucket").agg(F.sum("n_raw").alias("r"), F.sum("n_good").alias("g")).collect())
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, g in counts:
        raw[b], good[b] = r, g
    p_raw = (raw + 1) / (raw.sum() + BUCKETS)
    p_good = (good + PRIOR_MASS * p_raw) / (good.sum() + PRIOR_MASS)
    weights = np.rint(np.log(p_good / p_raw) * SCALE).astype(np.int64)

    def held_out(batches):
        for batch in batches:
            col = batch.column("text")
            totals, ns = [], []
            for blk in text_blocks(col):
                t, n = _score(blk, _word_hashes(blk), weights)
                totals.append(t)
                ns.append(n)
            if totals:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("good"), pa.array(np.concatenate(totals)),
                     pa.array(np.concatenate(ns).astype(np.int64))], names=["good", "total", "n"])

    test = (text.join(sample.where("NOT fit").select("doc_id", "good"), "doc_id")
            .select("text", "good").mapInArrow(held_out, "good boolean, total long, n long")
            .where("n > 0").select("good", F.floor(F.col("total") / F.col("n")).alias("s")).collect())
    return Model(weights, place_threshold([r.s for r in test if r.good],
                                          [r.s for r in test if not r.good]))


def place_threshold(good: list[int], bad: list[int]) -> int | None:
    """The threshold with the best balanced accuracy on held-out rows; of
    equals, the middle of the widest gap so that good rows are kept."""
    if not good or not bad:
        return None
    g, b = np.sort(np.array(good)), np.sort(np.array(bad))
    cuts = np.unique(np.concatenate([g, b + 1]))
    score = ((len(g) - np.searchsorted(g, cuts)) / len(g) + np.searchsorted(b, cuts) / len(b))
    best = cuts[np.flatnonzero(score == score.max())]
    below = b[b < best[0]]
    low = int(below[-1]) if len(below) else int(best[0]) - 1
    return (low + int(best[0])) // 2 + 1 if best[0] > low + 1 else int(best[0])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id and the digest columns."""
    def task(batches):
        for batch in batches:
            if batch.num_rows:
                m = model.evaluate(batch.column("text"))
                names = [c.split()[0] for c in DIGEST.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(m[c]) for c in names)], names=["doc_id", *names])
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(task, f"doc_id {kind}, {DIGEST}")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` (all their columns) that the rules keep."""
    def task(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.evaluate(batch.column("text"))["kept"]))
    return docs.mapInArrow(task, docs.schema)


def quality_rules(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """Operator 8: fit on the corpus, then decide every document."""
    return score_documents(docs, fit(docs, labels, max_labels))
