"""Repeated regions: which passages of at least `window` elements may occur
twice in a corpus, found without shuffling text.

Used by the exact repeat operators (9: bytes, 10: words) as a lossless filter.

*Anchors.*  Each window of `window` elements has an anchor: its leftmost
k-gram of least hash.  Equal windows have equal anchors at equal places, so
both meet under the anchor's key.  The consecutive windows that share an
anchor are one row: (key, digest of their elements, document, offset).  There
are about 2 / (window - k + 2) rows an element.

*Repeats.*  A key met once cannot belong to a repeated window: its rows go.
Rows of equal key and digest are copies of one another; only their first is
compared further (`classes`), which folds groups of copies of any size into
one row by partial aggregation.  First rows of keys with several digests are
sent, with their elements, to the exact comparison (`slices`).

*Hot keys.*  A passage that very many documents hold gives its keys about as
many different slices, as each end of it runs on into its own document.  Keys of
more slices than a shard holds are not gathered: their windows are compared as
rows, grouped by Spark (`hot_ranges`).  So no task holds more slices of a key
than that, whatever the corpus.

A document is known by (doc_id, hash of its text): rows that repeat both are
one document.  A null doc_id stands for the smallest integer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .textbatch import NULL_ID, U64, Slices, TextBlock, mix, text_blocks, window_argmin

PIECE = 1 << 22

ANCHORS = "key long, digest long, doc_id long, th int, off int, rel int, n int"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the doc_id that stands for null."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")


def text_hash(blk: TextBlock) -> np.ndarray:
    return (Slices(blk.data).hash(blk.start, blk.end) >> U64(32)).astype(np.uint32).view(np.int32)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def window_groups(grams: np.ndarray, body: Slices, start: np.ndarray, end: np.ndarray, window: int, k: int):
    """Runs of windows with one anchor: (key, digest, document, first window,
    anchor - first window, number of windows); indices are of the block."""
    total = body.total
    long = (end - start) >= window
    if not long.any():
        return None
    out = []
    # A long block is taken in pieces of windows, so that memory is bounded.
    for p0 in range(0, total - window + 1, PIECE):
        p1 = min(p0 + PIECE, total - window + 1)
        arg = window_argmin((grams[p0:p1 + window - k] >> U64(32)), window - k + 1) + p0
        edge = np.zeros(p1 - p0 + 1, dtype=np.int32)
        lo, hi = np.clip(start[long], p0, p1) - p0, np.clip(end[long] - window + 1, p0, p1) - p0
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi, -1)
        valid = np.cumsum(edge[:-1]) > 0
        same = np.zeros(p1 - p0, dtype=bool)
        same[1:] = (arg[1:] == arg[:-1]) & valid[:-1]
        begin = np.flatnonzero(valid & ~same)
        last = np.ones(p1 - p0, dtype=bool)
        last[:-1] = ~(same[1:] & valid[1:])
        stop = np.flatnonzero(valid & last)
        out.append((begin + p0, stop + p0, arg[begin]))
    l, r, a = (np.concatenate(x) for x in zip(*out, strict=True))
    key = grams[a]
    digest = mix(body.hash(l, r + window) + (a - l + 1).astype(U64) * U64(0xE7037ED1A0B428DB))
    doc = np.searchsorted(start, l, side="right") - 1
    return key, digest, doc, l, a - l, r - l + 1


def anchor_rows(docs: DataFrame, elements: Callable, window: int, k: int) -> DataFrame:
    """ANCHORS rows of all documents.

    elements(block) -> (k-gram hashes, Slices of the elements, start, end)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for blk in text_blocks(batch.column("text")):
                grams, body, start, end = elements(blk, k)
                found = window_groups(grams, body, start, end, window, k)
                if found is None:
                    continue
                key, digest, doc, first, rel, n = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key)), pa.array(signed(digest)), pa.array(ids[blk.row0 + doc]),
                     pa.array(text_hash(blk)[doc]), pa.array((first - start[doc]).astype(np.int32)),
                     pa.array(rel.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["key", "digest", "doc_id", "th", "off", "rel", "n"])
    return keyed(docs).mapInArrow(task, ANCHORS)


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read again: cuts the lineage,
    and a lost executor does not cost what was done before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def repeated_anchors(docs: DataFrame, elements: Callable, window: int, k: int) -> DataFrame:
    """The anchor rows whose key occurs at least twice (saved).

    The keys are saved before the join: both of its sides are then plain
    exchanges, and adaptive execution splits the partition of a hot key."""
    rows = anchor_rows(docs, elements, window, k)
    twice = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "keys")
    return saved(rows.join(twice, "key"), "anchors")


def classes(anchors: DataFrame) -> DataFrame:
    """(key, digest, c, doc_id, th, off, rel, n): the first row of each class
    of equal slices and its size (saved)."""
    g = anchors.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("c"),
                                             F.min(F.struct("doc_id", "th", "off", "rel", "n")).alias("rep"))
    return saved(g.select("key", "digest", "c", "rep.*"), "classes")


def compared_classes(kinds: DataFrame, group_slices: int) -> tuple[DataFrame, DataFrame | None]:
    """The classes that share their key with another class: of keys with up to
    `group_slices` of them, and of the others (None: there are none)."""
    several = saved(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "several")
    few, many = (kinds.join(several.where(w).select("key"), "key") for w in (f"kinds <= {group_slices}", f"kinds > {group_slices}"))
    return few, None if several.where(f"kinds > {group_slices}").isEmpty() else many


def repeated_documents(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, th, text) of the documents that have repeated anchors (saved):
    the only documents whose text is shuffled, once."""
    ids = anchors.select("doc_id").distinct()

    def task(batches):
        for batch in batches:
            th = [text_hash(b) for b in text_blocks(batch.column("text"))]
            if th:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(th)),
                                                  batch.column("text")], names=["doc_id", "th", "text"])
    some = keyed(docs).join(ids, "doc_id", "left_semi")
    return saved(some.mapInArrow(task, "doc_id long, th int, text string"), "repeated")


def per_document(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per (doc_id, th): the arrays of its rows."""
    return rows.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct(*columns))).alias("items"))


def slices(texts: DataFrame, reps: DataFrame, cut: Callable) -> DataFrame:
    """(key, doc_id, th, off, n, body) for class representatives.

    cut(text bytes, offsets, counts) -> list of binary bodies."""
    def task(batches):
        for batch in batches:
            rows = {c: [] for c in ("key", "doc_id", "th", "off", "n", "body")}
            size = 0
            for d, t, text, items in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(),
                                         batch.column("text"), batch.column("items").to_pylist(), strict=True):
                off = np.array([i["off"] for i in items])
                n = np.array([i["n"] for i in items])
                bodies = cut(text.as_py().encode("utf-8", "surrogatepass"), off, n)
                rows["key"] += [i["key"] for i in items]
                rows["doc_id"] += [d] * len(items)
                rows["th"] += [t] * len(items)
                rows["off"] += off.tolist()
                rows["n"] += n.tolist()
                rows["body"] += bodies
                size += sum(map(len, bodies))
                if size > 1 << 24:
                    yield _slice_batch(rows)
                    rows, size = {c: [] for c in rows}, 0
            if rows["key"]:
                yield _slice_batch(rows)
    todo = per_document(reps, ["key", "off", "n"])
    return (texts.join(todo, ["doc_id", "th"])
            .mapInArrow(task, "key long, doc_id long, th int, off int, n int, body binary"))


def _slice_batch(rows: dict) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "doc_id": pa.int64(), "th": pa.int32(), "off": pa.int32(), "n": pa.int32(),
             "body": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(rows[c], t) for c, t in kinds.items()], names=list(kinds))


_RUNS = ("key long, r int, core long, lo int, m int, full long, doc_id long, th int, pos int, digests array<long>")


def hot_ranges(texts: DataFrame, reps: DataFrame, elements: Callable, width: int, step: int, later_only: bool) -> DataFrame:
    """(doc_id, th, s, e) of the repeated windows of hot keys, by rows.

    A slice's windows are cut into runs of `step`, counted from the anchor, so
    that runs meet their like.  All windows of a run hold the same core; a run
    whose core occurs once holds no repeated window and goes.  Equal runs fold
    by partial aggregation; the windows of the different ones are compared one
    by one.  `later_only`: without the first of equal windows.

    elements(text bytes) -> array of the elements."""
    def task(batches):
        for batch in batches:
            rows: list[tuple] = []
            for d, t, text, items in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(),
                                         batch.column("text"), batch.column("items").to_pylist(), strict=True):
                body = Slices(elements(text.as_py().encode("utf-8", "surrogatepass")))
                for i in items:
                    key, off, rel, n = i["key"], i["off"], i["rel"], i["n"]
                    w = np.arange(n)
                    digests = body.hash(off + w, off + w + width)
                    run = (w - rel) // step
                    begin = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
                    end = np.append(begin[1:], n)
                    at = off + rel + run[begin] * step  # where the whole run would begin
                    cores = signed(body.hash(at + step - 1, at + width)).tolist()
                    for x, y, r, core in zip(begin.tolist(), end.tolist(), run[begin].tolist(), cores, strict=True):
                        own = digests[x:y]
                        rows.append((key, r, core, x - rel - r * step, y - x, int(signed(Slices(own).hash(np.array([0]), np.array([y - x])))[0]),
                                     d, t, off + x, signed(own).tolist()))
                if len(rows) > 20_000:
                    yield _run_batch(rows)
                    rows = []
            if rows:
                yield _run_batch(rows)
    todo = per_document(reps, ["key", "off", "rel", "n"])
    runs = saved(texts.join(todo, ["doc_id", "th"]).mapInArrow(task, _RUNS), "runs")
    spot = ["key", "r", "core"]
    cores = saved(runs.groupBy(*spot).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*spot), "cores")
    live = saved(runs.join(cores, spot).drop("core"), "live")
    kind, place = ["key", "r", "lo", "m", "full"], F.struct("doc_id", "th", "pos")
    kinds = saved(live.groupBy(*kind).agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("rep"),
                                          F.min("digests").alias("digests")), "runkinds")
    copies = live.drop("digests").join(kinds.where("c > 1").select(*kind, "rep"), kind)
    if later_only:
        copies = copies.where(place != F.col("rep"))
    folded = copies.select("doc_id", "th", F.col("pos").alias("s"), (F.col("pos") + F.col("m") - 1 + width).alias("e"))
    windows = kinds.select("key", "r", "lo", "rep", F.posexplode("digests").alias("i", "digest")).select(
        "key", (F.col("r") * step + F.col("lo") + F.col("i")).alias("a"), "digest",
        F.struct("rep.doc_id", "rep.th", (F.col("rep.pos") + F.col("i")).alias("pos")).alias("at"))
    same = ["key", "a", "digest"]
    met = windows.groupBy(*same).agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("least")).where("c > 1")
    hit = windows.join(met.select(*same, "least"), same)
    if later_only:
        hit = hit.where("at > least")
    return folded.unionByName(hit.select("at.doc_id", "at.th", F.col("at.pos").alias("s"), (F.col("at.pos") + width).alias("e")))


def _run_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(),
             pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=[c.split()[0] for c in _RUNS.split(", ")])


def shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[dict]:
    """Rows sorted by key, in shards of about `limit` body bytes that end
    between keys; rows that repeat (key, doc_id, th, off) come once."""
    held: dict[str, list] = {c: [] for c in ("key", "doc_id", "th", "off", "n", "body")}
    size, seen = 0, set()
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in held}
        for i, key in enumerate(cols["key"]):
            if held["key"] and key != held["key"][-1]:
                seen.clear()
                if size >= limit:
                    yield held
                    held, size = {c: [] for c in held}, 0
            at = (cols["doc_id"][i], cols["th"][i], cols["off"][i])
            if at in seen:
                continue
            seen.add(at)
            for c in held:
                held[c].append(cols[c][i])
            size += len(cols["body"][i])
    if held["key"]:
        yield held


def spans(starts: np.ndarray, width: int):
    """Union of [s, s + width) over sorted starts, as (from, to) arrays."""
    if len(starts) == 0:
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > width)
    lo = starts[np.concatenate([[0], cut + 1])]
    hi = starts[np.concatenate([cut, [len(starts) - 1]])] + width
    return lo, hi


def covered(n: int, items: list[dict]) -> np.ndarray:
    """Flags of the elements that the (s, e) items cover."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, [i["s"] for i in items], 1)
    np.add.at(edge, [i["e"] for i in items], -1)
    return np.cumsum(edge[:-1]) > 0


def restore_id(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
