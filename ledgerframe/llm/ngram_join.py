"""N-gram Jaccard join (4): near copies by word shingles, exact.

1. *Sets.*  Distinct `k`-word shingles of each text, as sorted 64-bit hashes
   (a shorter text: its whole word sequence).  Texts of equal sets are one
   class, known by two digests; its first doc_id stands for it.
2. *Clusters.*  Of a set in hash order, take the pairs of neighbours.  Sets of
   a and b shingles with o in common share at least 3 * o - a - b - 1 pairs, as
   each of the a + b - 2 * o others parts one pair of common neighbours; at
   similarity t > 1/2 that is (2 * t - 1) * a - 1 or more.  So they share one of
   the first a - ceil((2 * t - 1) * a) + 1 pairs in any common order.  (Single
   shingles would do with half as many, but one chance shingle of five common
   words then ties two texts together, and half a corpus becomes one cluster.)
   The order puts pairs with one of the corpus's frequent shingles last (a
   bounded heavy-hitter list, which only affects speed), so that passages
   shared by many do not tie documents together.  Classes that share a pair are
   linked to the least of them; a task emits a pair once, however many copies
   it holds.  Components of these candidate links are clusters: a similar pair
   of documents is always inside one.
3. *Join.*  A cluster's sets meet in one task (a large cluster: in several, by
   size class and hash, every pair of parts that may match in one of them) and
   are joined by signature trees (`signature_tree`): exact, and pruned.
4. Components of the verified links, spread over the classes.

A text is known by (doc_id, xxhash64 of it), a class by the two digests of its
set; the first digest names it in links.

Cases: null text, or a text without words, has an empty set, is linked with
nothing and is its own component; repeated rows are copies; different texts
under one doc_id are different texts; a null doc_id stands for the smallest id
(component_id null); a very long text is a block of its own; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import regions as R
from .components import components
from .signature_tree import link_components
from .textbatch import GRAM_CODE, LOWER, NULL_ID, U64, TextBlock, grams, mix, span_hash, text_blocks

WORDS = 5
PERCENT = 80
FREQUENT = 100_000
PER_TASK = 4_096
GROUP_SHINGLES = 1_200_000
GROUP_MIN = 3
UNIT_SHINGLES = 2_000_000
COMBINE_ROWS = 1_000_000


def shingle_sets(blk: TextBlock, k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a block."""
    data = LOWER[blk.data]
    ws, we, first = blk.words(data)
    wh = span_hash(data, ws, we)
    full = grams(wh, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= k:
            out.append(np.unique(full[a:b - k + 1]))
        elif n:
            out.append(mix(grams(wh[a:b], n) + U64(n)))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def _digests(s: np.ndarray) -> tuple[int, int]:
    if len(s) == 0:
        return 0, 0
    a = int(mix(s + U64(0x8EBC6AF09C88C6E3)).sum(dtype=U64))
    b = int(np.bitwise_xor.reduce(mix(s ^ U64(0x589965CC75374CC3))))
    both = np.array([a ^ len(s), b], dtype=U64)
    x, y = mix(both).view(np.int64).tolist()
    return x, y


def prefix_pairs(s: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the prefix of a set's neighbour pairs, rare ones first.  Sets
    of one shingle have none: they are similar to equal sets only."""
    n = len(s)
    q = mix(s[:-1] * GRAM_CODE[0] + s[1:] * GRAM_CODE[1])
    p = n - (-(-(2 * percent - 100) * n // 100)) + 1
    if len(often):
        late = often[np.minimum(np.searchsorted(often, s), len(often) - 1)] == s
        late = late[:-1] | late[1:]
        if late.any():
            first = np.sort(q[~late])[:p]
            return np.concatenate([first, np.sort(q[late])[:max(0, p - len(first))]])
    return np.sort(q)[:p]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text), th: the hash of the text (null: of the empty one)."""
    return R.keyed(docs).select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("th"), "text")


def document_sets(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """One pass, saved: (kind 0) doc_id, th, uid, d2, n of every document;
    (kind 1) each task's most frequent shingles: uid = shingle, n = documents."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often: dict[int, int] = {}
        held: dict[int, np.ndarray] = {}   # sets by digest: copies count once
        size = 0

        def count():
            each, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
            some = n >= GROUP_MIN
            for h, c in zip(each[some].view(np.int64).tolist(), n[some].tolist(), strict=True):
                often[h] = often.get(h, 0) + c
            held.clear()

        for batch in batches:
            ids, th = (batch.column(c).to_numpy() for c in ("doc_id", "th"))
            for blk in text_blocks(batch.column("text")):
                sets = shingle_sets(blk, k)
                own = slice(blk.row0, blk.row0 + blk.n)
                digests = np.array([_digests(s) for s in sets], dtype=np.int64).reshape(-1, 2)
                yield _document_batch(0, ids[own], th[own], digests[:, 0], digests[:, 1], np.array([len(s) for s in sets]))
                held.update(zip(digests[:, 0].tolist(), sets, strict=True))
                size += sum(map(len, sets))
                if size > GROUP_SHINGLES:
                    count()
                    size = 0
                    if len(often) > 32 * PER_TASK:
                        top = sorted(often.items(), key=lambda x: (-x[1], x[0]))[:8 * PER_TASK]
                        often.clear()
                        often.update(top)
        if held:
            count()
        top = sorted(often.items(), key=lambda x: (-x[1], x[0]))[:PER_TASK]
        if top:
            h, c = (np.array(x, dtype=np.int64) for x in zip(*top, strict=True))
            none = np.zeros(len(h), np.int64)
            yield _document_batch(1, none, none, h, none, c)
    rows = _keyed(docs).mapInArrow(task, "kind int, doc_id long, th long, uid long, d2 long, n long")
    return R.saved(rows, "sets")


def _document_batch(kind: int, doc_id, th, uid, d2, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(uid), kind, np.int32)), pa.array(doc_id), pa.array(th), pa.array(uid), pa.array(d2),
         pa.array(np.asarray(n, dtype=np.int64))], names=["kind", "doc_id", "th", "uid", "d2", "n"])


def frequent_shingles(sets: DataFrame, size: int = FREQUENT) -> np.ndarray:
    """The most frequent shingles, at most `size` (8 bytes each)."""
    top = (sets.where("kind = 1").groupBy("uid").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "uid").limit(size).select("uid").collect())
    return np.sort(np.array([r.uid for r in top], dtype=np.int64).view(U64))


def candidate_links(docs: DataFrame, frequent: np.ndarray, k: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that share a prefix pair, to the least."""
    if percent <= 50:
        raise ValueError("neighbour pairs are a filter for similarities above one half")
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def combine(h, u):
        """A pair's first class goes on; the others are linked to it here."""
        h, u = np.concatenate(h), np.concatenate(u)
        o = np.lexsort((u, h))
        h, u = h[o], u[o]
        head = np.append(True, h[1:] != h[:-1])
        lead = u[np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))]
        link = lead != u
        pair = np.unique(np.stack([lead[link], u[link]], axis=1), axis=0) if link.any() else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(R.signed(h[head])), pa.array(u[head]), pa.nulls(int(head.sum()), pa.int64())], names=["h", "a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 0]), pa.array(pair[:, 1])],
                                         names=["h", "a", "b"])

    def prefixes(batches):
        often = shared.value
        hs, us, held = [], [], 0
        for batch in batches:
            for blk in text_blocks(batch.column("text")):
                for s in shingle_sets(blk, k):
                    if len(s) < 2:
                        continue
                    q = prefix_pairs(s, often, percent)
                    hs.append(q)
                    us.append(np.full(len(q), _digests(s)[0], dtype=np.int64))
                    held += len(q)
                if held > COMBINE_ROWS:
                    yield from combine(hs, us)
                    hs, us, held = [], [], 0
        if held:
            yield from combine(hs, us)

    def star(batches):
        last_h, lead = None, None
        for batch in batches:
            h = batch.column("h").to_numpy()
            a = batch.column("a").to_numpy()
            b = batch.column("b")
            made = np.asarray(b.is_valid())
            ready = [np.stack([a[made], b.filter(b.is_valid()).to_numpy()], axis=1)]
            h, a = h[~made], a[~made]
            if len(h):
                head = np.append(last_h is None or h[0] != last_h, h[1:] != h[:-1])
                at = np.maximum.accumulate(np.where(head, np.arange(len(h)), -1))
                first = np.where(at >= 0, a[np.maximum(at, 0)], a[0] if lead is None else lead)
                last_h, lead = h[-1], first[-1]
                link = first != a
                ready.append(np.stack([first[link], a[link]], axis=1))
            pair = np.unique(np.concatenate(ready), axis=0)
            if len(pair):
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    rows = R.keyed(docs).mapInArrow(prefixes, "h long, a long, b long")
    return rows.repartition("h").sortWithinPartitions("h", "a").mapInArrow(star, "a long, b long")


def join_tasks(reps: DataFrame, percent: int) -> DataFrame:
    """(doc_id, th, uid, d2, tasks): the tasks (root, pair, side) each class joins
    in; doc_id and th are those of the text that stands for it."""
    cls = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    r = reps.withColumn("cls", cls)
    whole = r.groupBy("root").agg(F.sum("n").alias("total"))
    part = r.groupBy("root", "cls").agg(F.sum("n").alias("part"))
    big = F.col("total") > UNIT_SHINGLES
    units = (part.join(whole, "root")
             .select("root", "cls", F.when(big, F.col("cls")).otherwise(0).alias("u"),
                     F.when(big, F.ceil(F.col("part") / UNIT_SHINGLES)).otherwise(1).alias("m")))
    r = (r.join(units, ["root", "cls"])
         .select("root", "doc_id", "th", "uid", "d2", "u", F.pmod(F.xxhash64("uid", "d2"), F.col("m")).cast("int").alias("c")))
    u = r.select("root", "u", "c").distinct()
    v = u.select(F.col("root").alias("vroot"), F.col("u").alias("vu"), F.col("c").alias("vc"))
    pairs = u.join(v, (F.col("root") == F.col("vroot")) & (
        ((F.col("vu") == F.col("u")) & (F.col("vc") >= F.col("c"))) | (F.col("vu") == F.col("u") + 1)))
    name = F.concat_ws(".", "u", "c", "vu", "vc")
    own = (F.col("u") == F.col("vu")) & (F.col("c") == F.col("vc"))
    left = pairs.select("root", "u", "c", name.alias("pair"), F.when(own, -1).otherwise(0).alias("side"))
    right = pairs.where(~own).select("root", F.col("vu").alias("u"), F.col("vc").alias("c"), name.alias("pair"),
                                     F.lit(1).alias("side"))
    return (r.join(left.unionByName(right), ["root", "u", "c"])
            .groupBy("doc_id", "th", "uid", "d2").agg(F.collect_list(F.struct("root", "pair", "side")).alias("tasks")))


def verified_links(docs: DataFrame, tasks: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between classes, by uid, that span the components of the
    similarity relation inside each task."""
    def sets(batches):
        for batch in batches:
            out = {c: [] for c in _SET}
            held = 0
            todo = batch.column("tasks").to_pylist()
            uid, d2 = batch.column("uid").to_pylist(), batch.column("d2").to_pylist()
            for blk in text_blocks(batch.column("text")):
                for i, s in enumerate(shingle_sets(blk, k), blk.row0):
                    body = s.tobytes()
                    for t in todo[i]:
                        for c, x in zip(_SET, (t["root"], t["pair"], t["side"], uid[i], d2[i], body), strict=True):
                            out[c].append(x)
                        held += len(body)
                        if held > 1 << 24:
                            yield _set_batch(out)
                            out, held = {c: [] for c in out}, 0
            if out["root"]:
                yield _set_batch(out)

    def join(batches):
        for group in _groups(batches):
            uid, side = np.array(group["uid"]), np.array(group["side"])
            label = link_components([np.frombuffer(x, dtype=U64) for x in group["body"]],
                                    None if (side < 0).all() else side, percent)
            least = np.full(len(uid), np.iinfo(np.int64).max)
            np.minimum.at(least, label, uid)
            lead = least[label]
            m = lead != uid
            if m.any():
                yield pa.RecordBatch.from_arrays([pa.array(lead[m]), pa.array(uid[m])], names=["a", "b"])

    # The tasks grow with the documents: never a broadcast.  Rows that repeat a
    # text and its doc_id come once.
    rows = (_keyed(docs).join(tasks.hint("merge"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th", "uid", "d2"])
            .select("text", "uid", "d2", "tasks")
            .mapInArrow(sets, "root long, pair string, side int, uid long, d2 long, body binary"))
    return rows.repartition("root", "pair").sortWithinPartitions("root", "pair").mapInArrow(join, "a long, b long")


_SET = {"root": pa.int64(), "pair": pa.string(), "side": pa.int32(), "uid": pa.int64(), "d2": pa.int64(), "body": pa.binary()}


def _set_batch(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in _SET.items()], names=list(_SET))


def _groups(batches) -> Iterator[dict]:
    """Rows of one (root, pair) at a time, from sorted batches."""
    held: dict[str, list] = {c: [] for c in ("side", "uid", "body")}
    at = None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("root", "pair", "side", "uid", "body")]
        for root, pair, side, uid, body in zip(*cols, strict=True):
            if at != (root, pair):
                if held["side"]:
                    yield held
                held, at = {c: [] for c in held}, (root, pair)
            held["side"].append(side)
            held["uid"].append(uid)
            held["body"].append(body)
    if held["side"]:
        yield held


def _components(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(every document: doc_id, th, uid, d2, n; every class with words: uid, d2,
    root): classes of one root are one component."""
    sets = document_sets(docs, k)
    table = sets.where("kind = 0").select("doc_id", "th", "uid", "d2", "n")
    clusters = components(candidate_links(docs, frequent_shingles(sets), k, percent), "clusters")
    kinds = (table.where("n > 0").groupBy("uid", "d2", "n").agg(F.min(F.struct("doc_id", "th")).alias("rep"))
             .select("uid", "d2", "n", "rep.*"))
    clustered = kinds.join(clusters.select(F.col("node").alias("uid"), "root"), "uid")
    tasks = R.saved(join_tasks(clustered, percent), "tasks")
    found = components(verified_links(docs, tasks, k, percent), "near")
    roots = kinds.join(found.select(F.col("node").alias("uid"), F.col("root").alias("least")), "uid", "left")
    return table, roots.select("uid", "d2", "doc_id", "th", F.coalesce("least", "uid").alias("root"))


def near_copies(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Operator 4: doc_id, n_shingles, component_id for every document."""
    table, roots = _components(docs, k, percent)
    first = roots.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = roots.select("uid", "d2", "root").join(first, "root").select("uid", "d2", "component")
    out = table.join(named, ["uid", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    return out.select(*(F.when(F.col(c) != NULL_ID, F.col(c)).alias(c) if c != "n_shingles" else F.col(c)
                        for c in out.columns))


def keep_one(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that stand for their group: of each component of texts
    the one with the least doc_id (then text hash); texts without words stand
    for themselves.  Rows that repeat both doc_id and text are one group's
    copies, so one of them stays."""
    table, roots = _components(docs, k, percent)
    first = roots.groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("rep")).select("rep.*")
    own = table.where("n = 0").select("doc_id", "th").distinct()
    kept = first.unionByName(own).join(table.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("copies")), ["doc_id", "th"])
    kept = R.saved(kept.select(F.col("doc_id").alias("k"), F.col("th").alias("t"), (F.col("copies") > 1).alias("again")), "kept")

    def rows(of: DataFrame) -> DataFrame:
        th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
        return docs.join(of, (F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)) == F.col("k")) & (th == F.col("t")),
                         "left_semi")
    once, again = rows(kept.where("NOT again")), kept.where("again")
    return once if again.isEmpty() else once.unionByName(rows(again).dropDuplicates(["doc_id", "text"]))
