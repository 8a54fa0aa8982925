"""Substring dedup (10): words covered by a window of `width` words that also
starts earlier in the corpus are removed.

Fixed-block anchors.  Documents are cut into non-overlapping reference blocks
of width / 2 words; any window of `width` words holds one whole block of its
document.  The blocks are indexed by hash and probed with every rolling window
of that length; each hit is extended to the windows around it, and runs of
repeated windows are the maximal exact repeats.

1. `regions` restricts index and probes, without loss, to slices of documents
   that may hold repeats; equal slices are folded into their first, which is
   earlier than all others.  Without it, every word of the corpus is a probe
   row to shuffle.
2. Slices that share a key are dealt to shards; a shard builds the index of
   its reference blocks, probes it, and extends the hits.  Of equal windows
   the earliest (doc_id, start) stays.
3. Removed ranges are gathered per document and applied.

Cases: null text has no words; documents below `width` words keep all; rows
that repeat doc_id and text are one document; of rows with one doc_id and
different texts the smaller text hash comes first; a null doc_id is the
smallest; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import regions as R
from .textbatch import SPACE, U64, Slices, TextBlock, grams, mix, span_hash, text_blocks

WIDTH = 20
GRAM = 5
SHARD_WORDS = 1_000_000
GROUP_SLICES = 32_768  # of a key: about a shard
HOT_STEP = 4


def _words_as_elements(blk: TextBlock, k: int):
    ws, we, first = blk.words()
    h = span_hash(blk.data, ws, we)
    return grams(h, k), Slices(h), first[:-1], first[1:]


def joined_sha(blk: TextBlock, gone: np.ndarray | None = None):
    """Per document: number of words and the SHA-256 of its kept words joined
    by one space."""
    ws, we, first = blk.words()
    keep = np.ones(len(ws), dtype=bool) if gone is None else ~gone
    data = np.empty(len(blk.data) + 1, dtype=np.uint8)
    data[:-1] = blk.data
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(edge, ws[keep], 1)
    np.add.at(edge, we[keep], -1)
    take = np.cumsum(edge[:-1]) > 0
    out, n = [], np.diff(first)
    # A kept word that is not its document's last one brings one space.
    kept = np.flatnonzero(keep)
    doc = np.searchsorted(first, kept, side="right") - 1
    inner = np.append(doc[1:] == doc[:-1], False) if len(kept) else np.zeros(0, bool)
    gap = we[kept[inner]]
    data[gap] = 0x20
    take[gap] = True
    acc = np.zeros(len(take) + 1, dtype=np.int64)
    np.cumsum(take, out=acc[1:])
    flat = data[take].tobytes()
    for a, b in zip(acc[blk.start].tolist(), acc[blk.end].tolist(), strict=True):
        out.append(hashlib.sha256(flat[a:b]).hexdigest())
    return n, out


def _whole(docs: DataFrame) -> DataFrame:
    def task(batches):
        for batch in batches:
            th, n, sha = [], [], []
            for blk in text_blocks(batch.column("text")):
                th.append(R.text_hash(blk))
                a, b = joined_sha(blk)
                n.append(a)
                sha += b
            if th:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.concatenate(th)), pa.array(np.concatenate(n)), pa.array(sha)],
                    names=["doc_id", "th", "n_words", "whole"])
    return R.keyed(docs).mapInArrow(task, "doc_id long, th int, n_words long, whole string")


def later_windows(shard: dict, width: int) -> list[np.ndarray]:
    """For each slice of a shard, the window starts (within the slice) whose
    words also start earlier in the shard."""
    block = max(1, width // 2)
    bodies = [np.frombuffer(b, dtype=np.uint64) for b in shard["body"]]
    size = np.array([len(b) for b in bodies])
    first = np.concatenate([[0], np.cumsum(size)])
    h = np.concatenate(bodies)
    owner = np.repeat(np.arange(len(bodies)), size)
    at = np.arange(len(h)) - first[owner]
    off = np.array(shard["off"], dtype=np.int64)
    key = mix(np.array(shard["key"], dtype=np.int64).view(U64))

    # Index of reference blocks: whole blocks at multiples of the block length
    # of their document; probes: every rolling window of that length.
    probe = grams(h, block)
    live = at[:len(probe)] + block <= size[owner[:len(probe)]]
    probe = mix(probe ^ key[owner[:len(probe)]])
    ref = live & ((off[owner[:len(probe)]] + at[:len(probe)]) % block == 0)
    index = np.unique(probe[ref])
    spot = np.minimum(np.searchsorted(index, probe), max(len(index) - 1, 0))
    hit = live & (index[spot] == probe) if len(index) else np.zeros(len(probe), dtype=bool)
    met = np.bincount(spot[hit], minlength=max(len(index), 1))
    hit &= met[spot] > 1

    # Extend: the windows of `width` words that hold a hit block.
    full = grams(h, width)
    n = np.array(shard["n"], dtype=np.int64)
    start = np.flatnonzero(at[:len(full)] < n[owner[:len(full)]])
    acc = np.concatenate([[0], np.cumsum(hit)])
    start = start[acc[start + width - block + 1] > acc[start]]
    whole = mix(full[start] ^ key[owner[start]])
    doc = np.array(shard["doc_id"], dtype=np.int64)[owner[start]]
    th = np.array(shard["th"], dtype=np.int64)[owner[start]]
    place = off[owner[start]] + at[start]
    order = np.lexsort((place, th, doc, whole))
    late = np.zeros(len(start), dtype=bool)
    late[order[1:]] = whole[order[1:]] == whole[order[:-1]]
    got = start[late]
    cut = np.searchsorted(got, first)
    return [got[cut[i]:cut[i + 1]] - first[i] for i in range(len(bodies))]


def repeated_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM,
                    shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """((doc_id, th, s, e): word ranges to remove, texts of their documents)."""
    anchors = R.repeated_anchors(docs, _words_as_elements, width, min(gram, width))
    kinds = R.classes(anchors)
    texts = R.repeated_documents(docs, anchors)

    first = kinds.where("c > 1").select("key", "digest", F.struct("doc_id", "th", "off").alias("rep"))
    folded = (anchors.join(first, ["key", "digest"])
              .where(F.struct("doc_id", "th", "off") != F.col("rep"))
              .select("doc_id", "th", F.col("off").alias("s"), (F.col("off") + F.col("n") - 1 + width).alias("e")))

    def word_hashes(raw: bytes) -> np.ndarray:
        blk = TextBlock(np.frombuffer(raw, dtype=np.uint8), np.array([0]), np.array([len(raw)]), 0)
        ws, we, _ = blk.words()
        return span_hash(blk.data, ws, we)

    def cut(raw: bytes, off, n):
        h = word_hashes(raw)
        return [h[o:o + m - 1 + width].tobytes() for o, m in zip(off.tolist(), n.tolist(), strict=True)]

    def compare(batches):
        for shard in R.shards(batches, 8 * shard_words):
            rows = []
            for d, t, off, starts in zip(shard["doc_id"], shard["th"], shard["off"],
                                         later_windows(shard, width), strict=True):
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
        compared = compared.unionByName(R.hot_ranges(texts, many, word_hashes, width, HOT_STEP, later_only=True))
    return folded.unionByName(compared), texts


def _apply(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    def task(batches):
        for batch in batches:
            items = batch.column("items").to_pylist()
            removed, sha = [], []
            for blk in text_blocks(batch.column("text")):
                _, _, first = blk.words()
                gone = np.concatenate([R.covered(int(b - a), items[blk.row0 + i])
                                       for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True))])
                removed += [int(gone[a:b].sum()) for a, b in zip(first[:-1], first[1:], strict=True)]
                sha += joined_sha(blk, gone)[1]
            if sha:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("th"), pa.array(removed, pa.int64()), pa.array(sha)],
                    names=["doc_id", "th", "n_removed", "sha"])
    items = R.per_document(ranges, ["s", "e"])
    return (texts.join(items, ["doc_id", "th"])
            .mapInArrow(task, "doc_id long, th int, n_removed long, sha string")
            .dropDuplicates(["doc_id", "th"]))


def remove_later_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Operator 10: doc_id, n_words, n_removed, kept_sha256."""
    ranges, texts = repeated_ranges(docs, width)
    out = _whole(docs).join(_apply(texts, ranges), ["doc_id", "th"], "left")
    return R.restore_id(out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("sha", "whole").alias("kept_sha256")))
