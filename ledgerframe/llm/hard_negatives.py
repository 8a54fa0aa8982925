"""Operator 13: hard-negative mining with an inverted multi-index.

*Index.*  Vectors are split into two halves; k-means on a bounded sample gives
each half a codebook, and a row's two codes name its cell.  All rows are coded
and dealt out into blocks of neighbouring cells; a block keeps its rows sorted
by (cell, label), and the largest distance (radius) of its half vectors from
each code's centre.

*Bounds.*  No row of a cell scores more with an anchor than
sum over halves of (anchor half · centre + |anchor half| * radius).

*Search.*  The two lists of half bounds are sorted, and a heap walks their
sums from the largest down (the multi-sequence algorithm): cells come in the
order of their bounds.  A search ends once what it looks for is certified: for
positives when the fifth best row of the anchor's label beats the next cell's
bound; for the negatives of a positive when the third best row inside its score
window beats it, or the bound falls below the window.  So results are exact
for any codebook, and the sample only decides how early a search ends.

*Scale.*  The anchors (a fixed fraction of the rows, all of them) meet all
rows in blocks: rows are sent once for each block of anchors, anchors once for
each block of rows, and a task holds one block of either.  Each pair of blocks
returns a few rows per anchor, merged by a ranked window.  Blocks are ranges of
(cell, row), so a vector that a third of all rows repeat fills several.  Before
the search each anchor gets floors from the sample: what it finds there bounds
the result from below, so that far blocks are left at their first cell.

*Scores* are integer inner products of floor(scale * component), in the
narrowest float type that holds every partial sum exactly, otherwise in longs.

Defined results: rows with a null vec_id, label or vector, an empty vector, or a
null or non-finite component, take no part, nor do rows whose integer squared norm
exceeds 2^62 (their scores would not fit a long); vectors are compared with
those of their own length only; rows that repeat a vec_id are rows of their
own; ties go by vec_id; other columns are not read; an empty table, or one
without anchors, gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .regions import saved

SCALE, CODES, SAMPLE_ROWS, ROUNDS = 256, 16, 8192, 8
ROW_BLOCK, ANCHOR_BLOCK = 8192, 4096
ANCHOR_EVERY, POSITIVES, NEGATIVES = 50, 5, 3
LOW, HIGH = 50, 95  # a negative's score, in percent of its positive's
_FIT = 2.0 ** 62
NO_SCORE = -(1 << 63)


# --- vectors -----------------------------------------------------------------

def usable(embeddings: DataFrame, scale: int) -> DataFrame:
    """(uid, vec_id, label, dim, vec): rows that take part, vec as the bytes of
    little-endian longs."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            size = np.diff(vec.offsets.to_numpy())
            flat = vec.flatten().to_numpy(zero_copy_only=False)
            q = np.floor(flat * scale)
            row = np.repeat(np.arange(len(size)), size)
            norm = np.bincount(row, q * q, len(size))
            keep = np.flatnonzero(norm <= _FIT)  # also false for nan
            at = np.concatenate([[0], np.cumsum(size)])
            good = np.zeros(len(q), dtype=bool)
            good[np.isin(row, keep)] = True
            codes = np.where(good, q, 0).astype("<i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(keep)) for c in ("uid", "vec_id", "label")]
                + [pa.array(size[keep].astype(np.int32)), pa.array([codes[at[i]:at[i + 1]].tobytes() for i in keep], pa.binary())],
                names=["uid", "vec_id", "label", "dim", "vec"])
    rows = embeddings.select(
        F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long"), F.col("label").cast("long"),
        F.col("embedding").cast("array<double>").alias("vec"))
    whole = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL AND NOT exists(vec, x -> x IS NULL)")
    return whole.mapInArrow(task, "uid long, vec_id long, label long, dim int, vec binary")


def matrix(column, dim: int) -> np.ndarray:
    """The vectors of a binary column, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8").reshape(-1, dim)


def exact_type(a: np.ndarray, b: np.ndarray):
    """A type in which a @ b is exact: a partial sum is at most |a||b|."""
    def longest(x):
        return float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    top = longest(a) * longest(b)
    return np.float32 if top < 2 ** 23 else np.float64 if top < 2 ** 52 else np.int64


# --- codebooks and cells -----------------------------------------------------

def fit_codebook(half: np.ndarray, codes: int = CODES, rounds: int = ROUNDS) -> np.ndarray:
    """k-means centres of one half, started from rows spread over the sample."""
    half = half.astype(np.float64)
    if half.shape[1] == 0 or len(half) == 0:
        return np.zeros((1, half.shape[1]))
    seeds = np.unique(half, axis=0)
    centres = seeds[np.unique(np.linspace(0, len(seeds) - 1, codes).astype(int))]
    for _ in range(rounds):
        code = nearest(half, centres)
        total = np.zeros_like(centres)
        np.add.at(total, code, half)
        n = np.bincount(code, minlength=len(centres))
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (0.5 * (centres ** 2).sum(axis=1) - half @ centres.T).argmin(axis=1)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = x.shape[1] // 2
    return x[:, :cut], x[:, cut:]


class Block:
    """Rows as an inverted multi-index: sorted by (cell, label, vec_id), with
    the radius of each code in use."""

    def __init__(self, vec_id, uid, label, vec: np.ndarray, books: tuple[np.ndarray, np.ndarray], kind):
        first, second = (nearest(h.astype(np.float64), b) for h, b in zip(halves(vec), books, strict=True))
        order = np.lexsort((vec_id, label, second, first))
        self.vec_id, self.uid, self.label = vec_id[order], uid[order], label[order]
        self.vec = np.ascontiguousarray(vec[order].astype(kind))
        self.books, self.radius, self.codes = books, [], []
        self.size = [np.sqrt((b ** 2).sum(axis=1)) for b in books]
        for h, b, code in zip(halves(vec), books, (first, second), strict=True):
            far = np.zeros(len(b))
            np.maximum.at(far, code, np.sqrt(((h - b[code]) ** 2).sum(axis=1)))
            self.radius.append(far)
            self.codes.append(np.unique(code))
        name = first[order] * len(books[1]) + second[order]
        begin = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        end = np.append(begin[1:], len(name))
        self.lists = {int(name[b]): (int(b), int(e)) for b, e in zip(begin, end, strict=True)}

    def cells(self, q: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, from, to) of the block's cells for an anchor, from the
        largest bound down: a heap over the sums of two sorted lists."""
        bounds, codes = [], []
        for h, b, size, far, used in zip(halves(q[None, :]), self.books, self.size, self.radius, self.codes, strict=True):
            h = h[0].astype(np.float64)
            long = np.sqrt(h @ h)
            # The last term is more than the rounding of the others.
            u = b[used] @ h + long * far[used] + 1e-9 * long * (size[used] + far[used])
            down = np.argsort(-u, kind="stable")
            bounds.append(u[down].tolist())
            codes.append(used[down].tolist())
        (u, v), (c, d) = bounds, codes
        width = len(self.books[1])
        heap = [(-(u[0] + v[0]), 0, 0)]
        while heap:
            top, i, j = heapq.heappop(heap)
            if (found := self.lists.get(c[i] * width + d[j])) is not None:
                yield -top, *found
            if j + 1 < len(v):
                heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(u):
                heapq.heappush(heap, (-(u[i + 1] + v[0]), i + 1, 0))


def best(score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first by (score descending, vec_id)."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= cut)
        return near[np.lexsort((vec_id[near], -score[near]))[:k]]
    return np.lexsort((vec_id, -score))[:k]


def find_positives(block: Block, q: np.ndarray, uid: int, label: int, floor: int, k: int):
    """(score, vec_id) of the first k other rows of the label in the block,
    down to the floor; certified."""
    score, ids = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for bound, lo, hi in block.cells(q):
        if bound < (floor if len(score) < k else max(floor, score[-1])):
            break
        a, b = lo + np.searchsorted(block.label[lo:hi], [label, label + 1])
        if a == b:
            continue
        s = (block.vec[a:b] @ q).astype(np.int64)
        mine = (s >= floor) & (block.uid[a:b] != uid)
        score, ids = np.concatenate([score, s[mine]]), np.concatenate([ids, block.vec_id[a:b][mine]])
        at = best(score, ids, k)
        score, ids = score[at], ids[at]
    return score, ids


def find_negatives(block: Block, q: np.ndarray, label: int, windows: list[tuple[int, int]], floors: list[int], k: int):
    """For each window of scores [low, high]: (score, vec_id) of the first k
    rows of other labels inside it, down to its floor; certified."""
    n = len(windows)
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in range(n)]
    never = float("inf")  # of a window without scores
    need = [max(lo, f) if lo <= high else never for (lo, high), f in zip(windows, floors, strict=True)]
    least = min(need, default=never)
    for bound, lo, hi in block.cells(q):
        if bound < least:
            break
        s = (block.vec[lo:hi] @ q).astype(np.int64)
        other = np.flatnonzero((s >= least) & (block.label[lo:hi] != label))
        if len(other) == 0:
            continue
        s, ids = s[other], block.vec_id[lo:hi][other]
        for w, (_, high) in enumerate(windows):
            inside = (s >= need[w]) & (s <= high)
            if inside.any():
                score, held = np.concatenate([found[w][0], s[inside]]), np.concatenate([found[w][1], ids[inside]])
                at = best(score, held, k)
                found[w] = score[at], held[at]
                if len(at) == k:
                    need[w] = max(need[w], int(score[at[-1]]))
        least = min(need)
    return found


def window_of(positive: int) -> tuple[int, int]:
    """Scores s with LOW * positive <= 100 * s <= HIGH * positive."""
    return -(-LOW * positive // 100), HIGH * positive // 100


# --- distributed search ------------------------------------------------------

class Index:
    """The coded rows of one vector length in blocks (saved), their codebooks
    and the sample they were fitted on."""

    def __init__(self, rows: DataFrame, dim: int, anchor_every: int):
        sample = (rows.select("uid", "vec_id", "label", "vec").orderBy(F.xxhash64("vec_id", "uid"), "uid")
                  .limit(SAMPLE_ROWS).toArrow())
        vec = matrix(sample.column("vec"), dim)
        self.dim = dim
        self.books = tuple(fit_codebook(h) for h in halves(vec))
        self.sample = tuple(sample.column(c).to_numpy() for c in ("vec_id", "uid", "label")) + (vec,)
        n = rows.count()
        books, width = self.books, len(self.books[1])

        def cell(batches):
            for batch in batches:
                first, second = (nearest(h.astype(np.float64), b)
                                 for h, b in zip(halves(matrix(batch.column("vec"), dim)), books, strict=True))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((first * width + second).astype(np.int32))],
                                                 names=[*batch.schema.names, "cell"])
        coded = rows.mapInArrow(cell, "uid long, vec_id long, label long, dim int, vec binary, cell int")
        blocks = coded.repartitionByRange(max(1, -(-n // ROW_BLOCK)), "cell", "uid")
        self.rows = saved(blocks.withColumn("block", F.spark_partition_id()).drop("dim", "cell"), "index")
        self.blocks = self.rows.agg(F.max("block")).first()[0] + 1
        self.anchors = rows.where(F.col("vec_id") % anchor_every == 0).drop("dim")
        self.groups = max(1, -(-self.anchors.count() // ANCHOR_BLOCK))

    def seeds(self, kind) -> Block:
        vec_id, uid, label, vec = self.sample
        return Block(vec_id, uid, label, vec, self.books, kind)

    def each_pair(self, anchors: DataFrame, search, schema: str) -> DataFrame:
        """search(block, anchors as Table, their vectors) over all pairs of a
        block of rows and a block of anchors."""
        dim, books = self.dim, self.books

        def task(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
            if rows.num_rows == 0 or asked.num_rows == 0:
                return search.none
            vec, q = matrix(rows.column("vec"), dim), matrix(asked.column("vec"), dim)
            kind = exact_type(vec, q)
            block = Block(*(rows.column(c).to_numpy() for c in ("vec_id", "uid", "label")), vec, books, kind)
            return search(block, asked, q.astype(kind))
        pair = ["block", "part"]
        parts = F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))).alias("part")
        blocks = F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block")
        left = self.rows.select("*", parts)
        right = anchors.select("*", F.pmod(F.xxhash64("uid"), F.lit(self.groups)).cast("int").alias("part")).select("*", blocks)
        return left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(task, schema)


class Search:
    """A search over pairs of blocks, with the schema of what it returns."""

    def __init__(self, names: list[str], find):
        self.find = find
        self.none = pa.table({c: pa.array([], pa.int64()) for c in names})

    def __call__(self, block: Block, asked: pa.Table, q: np.ndarray) -> pa.Table:
        out: list[list] = [[] for _ in self.none.column_names]
        for row in self.find(block, asked, q):
            for held, x in zip(out, row, strict=True):
                held.append(x)
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64())
                         for c, x in zip(self.none.column_names, out, strict=True)})


def _first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows of each group by (score descending, vec_id), ranked."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "found_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives_of(index: Index, k: int) -> DataFrame:
    """(uid, anchor_id, rank, found_id, score): each anchor's first k other
    rows of its label (saved)."""
    dim, sample, books = index.dim, index.sample, index.books

    def floors(batches):
        """The k-th best score that the sample has for an anchor."""
        seeds = None
        for batch in batches:
            q = matrix(batch.column("vec"), dim)
            kind = exact_type(sample[3], q)
            seeds = Block(*sample, books, kind) if seeds is None or seeds.vec.dtype != kind else seeds
            uid, label = (batch.column(c).to_numpy() for c in ("uid", "label"))
            low = [NO_SCORE] * len(uid)
            for i, x in enumerate(q.astype(kind)):
                score, _ = find_positives(seeds, x, uid[i], label[i], NO_SCORE, k)
                low[i] = int(score[-1]) if len(score) == k else NO_SCORE
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.int64())], names=[*batch.schema.names, "floor"])
    anchors = saved(index.anchors.mapInArrow(floors, "uid long, vec_id long, label long, vec binary, floor long"), "anchors")

    def find(block, asked, q):
        uid, vec_id, label, floor = (asked.column(c).to_numpy() for c in ("uid", "vec_id", "label", "floor"))
        for i in range(len(q)):
            score, ids = find_positives(block, q[i], uid[i], label[i], floor[i], k)
            if len(score):
                yield np.full(len(score), uid[i]), np.full(len(score), vec_id[i]), ids, score
    found = index.each_pair(anchors, Search(["uid", "anchor_id", "found_id", "score"], find),
                            "uid long, anchor_id long, found_id long, score long")
    return saved(_first(found, ["uid", "anchor_id"], k), "positives")


def negatives_of(index: Index, positives: DataFrame, k: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    dim, sample, books = index.dim, index.sample, index.books
    wanted = positives.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("asked"))
    asked = index.anchors.join(wanted.select("uid", F.col("asked.score").alias("scores")), "uid")

    def floors(batches):
        """The k-th best score that the sample has in each window."""
        seeds = None
        for batch in batches:
            q = matrix(batch.column("vec"), dim)
            kind = exact_type(sample[3], q)
            seeds = Block(*sample, books, kind) if seeds is None or seeds.vec.dtype != kind else seeds
            low = []
            for x, label, scores in zip(q.astype(kind), batch.column("label").to_pylist(), batch.column("scores").to_pylist(), strict=True):
                windows = [window_of(s) for s in scores]
                found = find_negatives(seeds, x, label, windows, [NO_SCORE] * len(windows), k)
                low.append([int(s[-1]) if len(s) == k else NO_SCORE for s, _ in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("uid", "label", "vec", "scores")),
                                              pa.array(low, pa.list_(pa.int64()))], names=["uid", "label", "vec", "scores", "floors"])
    asked = saved(asked.select("uid", "label", "vec", "scores").mapInArrow(
        floors, "uid long, label long, vec binary, scores array<long>, floors array<long>"), "windows")

    def find(block, table, q):
        uid, label = (table.column(c).to_numpy() for c in ("uid", "label"))
        scores, low = (table.column(c).to_pylist() for c in ("scores", "floors"))
        for i in range(len(q)):
            for w, (score, ids) in enumerate(find_negatives(block, q[i], label[i], [window_of(s) for s in scores[i]], low[i], k)):
                if len(score):
                    yield np.full(len(score), uid[i]), np.full(len(score), w + 1), ids, score
    found = index.each_pair(asked, Search(["uid", "positive", "found_id", "score"], find),
                            "uid long, positive long, found_id long, score long")
    first = _first(found, ["uid", "positive"], k)
    pair = positives.select("uid", F.col("rank").cast("long").alias("positive"), "anchor_id",
                            F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return first.join(pair, ["uid", "positive"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def moved_labels(embeddings: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """The contract's planted label errors: one row in `every` by vec_id."""
    return embeddings.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels)
                                 .otherwise(F.col("label")))


def hard_negatives(embeddings: DataFrame, scale: int = SCALE, anchor_every: int = ANCHOR_EVERY,
                   positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """For each anchor (vec_id divisible by `anchor_every`) and each of its
    first `positives` rows of one label: the first `negatives` rows of other
    labels whose score is LOW to HIGH percent of the positive's."""
    rows = saved(usable(embeddings.select("vec_id", "embedding", "label"), scale), "vectors")
    out = None
    for (dim,) in sorted(rows.select("dim").distinct().collect()):
        if dim == 0:
            continue
        index = Index(rows.where(F.col("dim") == dim), dim, anchor_every)
        found = negatives_of(index, positives_of(index, positives), negatives)
        out = found if out is None else out.unionByName(found)
    if out is None:
        none = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return rows.sparkSession.createDataFrame([], none)
    return out
