"""Suffix-array dedup (9): every byte covered by a `width`-byte string that
also starts anywhere else in the corpus is removed.

1. `regions` finds, by anchors, the slices of text that may hold repeats; rows
   of equal slices are folded, so groups of copies cost one row a slice.
2. Slices that share an anchor but differ are dealt by anchor to shards, and
   each shard's suffixes are sorted by external induced sorting (`induced`):
   neighbours with a common prefix of `width` bytes are repeats.
3. Removed ranges are gathered per document and applied.

Matches never cross documents; bytes are those of UTF-8.  Strings are judged
on the input.  Cases: null text is empty; a text below `width` bytes keeps all;
rows that repeat a text (with the same doc_id or not) are repeats of it; a null
doc_id is kept as null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import regions as R
from .induced import repeated_starts
from .textbatch import RollingGrams, Slices, TextBlock, as_text, text_blocks

WIDTH = 400
GRAM = 64
SHARD_BYTES = 3_000_000
QUEUE_MEMORY = 1 << 27
GROUP_SLICES = 4_096  # of a key: about a shard
HOT_STEP = 16


def _bytes_as_elements(blk: TextBlock, k: int):
    return RollingGrams(blk.data).grams(k), Slices(blk.data), blk.start, blk.end


def _whole(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_bytes, kept_sha256) as if nothing were removed."""
    def task(batches):
        for batch in batches:
            th = [R.text_hash(b) for b in text_blocks(batch.column("text"))]
            if not th:
                continue
            raw = [t.as_py().encode("utf-8", "surrogatepass") for t in as_text(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(th)), pa.array([len(x) for x in raw], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in raw])],
                names=["doc_id", "th", "n_bytes", "whole"])
    return R.keyed(docs).mapInArrow(task, "doc_id long, th int, n_bytes long, whole string")


def repeated_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM,
                    shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """((doc_id, th, s, e): byte ranges to remove, texts of their documents)."""
    anchors = R.repeated_anchors(docs, _bytes_as_elements, width, min(gram, width))
    kinds = R.classes(anchors)
    texts = R.repeated_documents(docs, anchors)

    copies = anchors.join(kinds.where("c > 1").select("key", "digest"), ["key", "digest"], "left_semi")
    folded = copies.select("doc_id", "th", F.col("off").alias("s"), (F.col("off") + F.col("n") - 1 + width).alias("e"))

    def cut(raw: bytes, off, n):
        return [raw[o:o + m - 1 + width] for o, m in zip(off.tolist(), n.tolist(), strict=True)]

    def compare(batches):
        for shard in R.shards(batches, shard_bytes):
            rows = []
            found = repeated_starts(shard["body"], width, QUEUE_MEMORY)
            for d, t, off, starts in zip(shard["doc_id"], shard["th"], shard["off"], found, strict=True):
                lo, hi = R.spans(starts, width)
                rows += [(d, t, off + a, off + b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True),
                                                    (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)],
                    names=["doc_id", "th", "s", "e"])

    few, many = R.compared_classes(kinds, GROUP_SLICES)
    compared = (R.slices(texts, few, cut).repartition("key").sortWithinPartitions("key")
                .mapInArrow(compare, "doc_id long, th int, s int, e int"))
    if many is not None:
        compared = compared.unionByName(R.hot_ranges(
            texts, many, lambda raw: np.frombuffer(raw, dtype=np.uint8), width, HOT_STEP, later_only=False))
    return folded.unionByName(compared), texts


def _apply(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, th, n_removed, n_spans, kept_sha256, kept) of documents with ranges."""
    def task(batches):
        for batch in batches:
            out = []
            for text, items in zip(batch.column("text"), batch.column("items").to_pylist(), strict=True):
                data = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), dtype=np.uint8)
                gone = R.covered(len(data), items)
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            if out:
                removed, spans, sha = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("th"), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.int64()), pa.array(sha)],
                    names=["doc_id", "th", "n_removed", "n_spans", "sha"])
    items = R.per_document(ranges, ["s", "e"])
    return (texts.join(items, ["doc_id", "th"])
            .mapInArrow(task, "doc_id long, th int, n_removed long, n_spans long, sha string")
            .dropDuplicates(["doc_id", "th"]))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Operator 9: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    ranges, texts = repeated_ranges(docs, width)
    out = _whole(docs).join(_apply(texts, ranges), ["doc_id", "th"], "left")
    return R.restore_id(out.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256")))
