"""Benchmark decontamination (6): every training passage queries a BM25
inverted index of the benchmark items by block-max WAND; passages above an
item's threshold are verified by their question and answer overlap.

*Index.*  Items are cut into tokens (runs of ASCII letters, digits and
non-ASCII bytes, ASCII lower case).  Postings hold BM25 impacts divided by the
item's threshold, so one bound, 1, serves all items.  The threshold is `share`
of the least score that a stretch of the item as long as a passage is sure to
hold can have: every verbatim copy is retrieved, also of long items.  The index
is built of blocks of items: a block holds at most `block_postings` postings
(a proven bound) and is broadcast; with more items there are more blocks, and
every passage queries each of them.

*Query.*  A text is cut into passages of PASSAGE tokens, half overlapping.
Upper bounds prune in three steps, each over fewer passages: (1) essential
postings: an item's commonest terms, up to COMMON of its threshold, are taken
as present, so a passage can only reach the item with enough of its other
terms; (2) block maxima; (3) block-max WAND over the postings, which returns
all items that reach their threshold, not a top k.

*Verify.*  An item is a leak of a document when at least `overlap` of the
token 5-grams of its question (all sentences but the last) and of its answer
(the last) occur around the passage, or WHOLE_OVERLAP of the whole item's.

Cases: null text has no passages; a very long text is a block of its own, with
as many passages as it has; items without tokens match nothing; equal items are
all reported; repeated documents each report; empty tables give no rows; a null
doc_id is kept as null; `find_leaks` reads doc_id and text only, `drop_leaks`
hands all columns on whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import LOWER, U64, TextBlock, grams, span_hash, text_blocks

K1, B = 1.2, 0.75
PASSAGE = 128
SHARE = 0.5
OVERLAP = 0.5
WHOLE_OVERLAP = 0.6
GRAM = 5
BLOCK = 16
COMMON = 0.5
BLOCK_POSTINGS = 4_000_000

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[48:58] = True
_TOKEN[97:123] = True
_TOKEN[128:] = True

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def tokens(blk: TextBlock):
    """(token hashes, first token index of each document)."""
    data = LOWER[blk.data]
    data = np.where(_TOKEN[data], data, np.uint8(0x20))
    ws, we, first = blk.words(data)
    return span_hash(data, ws, we), first


def token_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return tokens(TextBlock(raw, np.array([0]), np.array([len(raw)]), 0))[0]


def question_and_answer(text: str) -> tuple[str, str]:
    """All sentences but the last, and the last; one sentence is both."""
    parts = [p for p in _SENTENCE.split(text) if len(token_hashes(p))]
    if len(parts) < 2:
        return text, text
    return " ".join(parts[:-1]), parts[-1]


def _item_grams(text: str) -> np.ndarray:
    h = token_hashes(text)
    n = min(GRAM, len(h))
    return np.unique(grams(h, n)) if n else np.zeros(0, dtype=U64)


class Index:
    """BM25 impacts of a block of items, over thresholds, with block maxima."""

    def __init__(self, items: list[tuple[int, str]], df: dict[int, int], n_items: int, mean_len: float,
                 share: float = SHARE, passage: int = PASSAGE):
        self.ids = np.array([i for i, _ in items], dtype=np.int64)
        self.parts = []
        rows: list[tuple[int, int, float]] = []
        sure = passage // 2 + 1
        for k, (_, text) in enumerate(items):
            h = token_hashes(text)
            q, a = question_and_answer(text)
            self.parts.append((len(h), _item_grams(q), _item_grams(a), _item_grams(text)))
            if len(h) == 0:
                continue
            term, tf = np.unique(h, return_counts=True)
            n = np.array([df[int(t)] for t in term.view(np.int64)], dtype=np.float64)
            idf = np.log1p((n_items - n + 0.5) / (n + 0.5))
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean_len))
            of = dict(zip(term.tolist(), impact.tolist(), strict=True))
            least = min(sum(of[t] for t in set(h[s:s + sure].tolist())) for s in range(max(1, len(h) - sure + 1)))
            rows += [(t, k, v / (share * least)) for t, v in of.items()]
        rows.sort()
        term = np.array([r[0] for r in rows], dtype=U64)
        self.terms, self.start = np.unique(term, return_index=True)
        self.start = np.append(self.start, len(rows))
        self.item = np.array([r[1] for r in rows], dtype=np.int64)
        # Rounded up a little: bounds may not fall below sums by rounding.
        self.impact = np.array([r[2] for r in rows], dtype=np.float64)
        self.top = np.zeros(len(self.terms))
        owner = np.repeat(np.arange(len(self.terms)), np.diff(self.start))
        np.maximum.at(self.top, owner, self.impact)
        # Block maxima of the (term, block) pairs that occur: no more than
        # there are postings.
        self.n_blocks = max(-(-len(items) // BLOCK), 1)
        pair, which = np.unique(owner * self.n_blocks + self.item // BLOCK, return_inverse=True)
        self.block_pair, self.block_top = pair, np.zeros(len(pair), dtype=np.float32)
        np.maximum.at(self.block_top, which, self.impact.astype(np.float32) * np.float32(1.0001))
        self.block_start = np.searchsorted(pair, np.arange(len(self.terms) + 1) * self.n_blocks)
        self._essential(owner, len(items))
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.terms >> U64(48)).astype(np.int64)] = True

    def _essential(self, owner: np.ndarray, n_items: int) -> None:
        """Split each item's postings: its commonest terms, while their impacts
        stay within COMMON, count as present (`given`); the others are kept
        by term, as the essential postings."""
        df = np.diff(self.start)[owner]
        order = np.lexsort((owner, -df, self.item))
        item, impact = self.item[order], self.impact[order]
        run = np.cumsum(impact)
        first = np.append(True, item[1:] != item[:-1])
        base = np.maximum.accumulate(np.where(first, run - impact, -np.inf)) if len(run) else run
        given = run - base <= COMMON
        self.given = np.bincount(item[given], weights=impact[given], minlength=n_items)
        keep = np.sort(order[~given])
        self.e_item, self.e_impact = self.item[keep], self.impact[keep]
        self.e_start = np.searchsorted(owner[keep], np.arange(len(self.terms) + 1))

    def top_in(self, terms: np.ndarray, block: int) -> float:
        """Sum of the terms' maxima in one block."""
        pair = terms * self.n_blocks + block
        spot = np.minimum(np.searchsorted(self.block_pair, pair), len(self.block_pair) - 1)
        return float(self.block_top[spot][self.block_pair[spot] == pair].sum(dtype=np.float64))

    def best_block(self, terms: np.ndarray) -> float:
        """The largest sum that the terms' maxima reach in any block."""
        n = self.block_start[terms + 1] - self.block_start[terms]
        at = np.repeat(self.block_start[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return float(np.bincount(self.block_pair[at] % self.n_blocks, weights=self.block_top[at], minlength=1).max())

    def term_of(self, h: np.ndarray) -> np.ndarray:
        """Index of each token's term, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        if len(self.terms):
            some = np.flatnonzero(self.seen[(h >> U64(48)).astype(np.int64)])
            spot = np.minimum(np.searchsorted(self.terms, h[some]), len(self.terms) - 1)
            good = self.terms[spot] == h[some]
            out[some[good]] = spot[good]
        return out

    def wand(self, terms: np.ndarray) -> list[int]:
        """All items that reach score 1 for the distinct query terms."""
        lists = [(int(self.start[t]), int(self.start[t + 1]), float(self.top[t]), int(t)) for t in terms]
        cursor = [[int(self.item[a]), a, b, top, t] for a, b, top, t in lists]
        found: list[int] = []
        eps = 1e-9
        while cursor:
            cursor.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for i, c in enumerate(cursor):
                total += c[3]
                if total >= 1 - eps:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursor[pivot][0]
            while pivot + 1 < len(cursor) and cursor[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            bound = self.top_in(np.array([c[4] for c in cursor[:pivot + 1]]), block)
            if bound < 1 - eps:
                # No item of this block among these lists: go to the block's
                # end, or to where a further list comes in.
                target = (block + 1) * BLOCK
                if pivot + 1 < len(cursor):
                    target = min(target, cursor[pivot + 1][0])
                target = max(target, item + 1)
                move = cursor[:pivot + 1]
            elif cursor[0][0] == item:
                score = sum(float(self.impact[c[1]]) for c in cursor[:pivot + 1])
                if score >= 1 - eps:
                    found.append(item)
                target, move = item + 1, cursor[:pivot + 1]
            else:
                target, move = item, [c for c in cursor[:pivot] if c[0] < item]
            for c in move:
                c[1] += int(np.searchsorted(self.item[c[1]:c[2]], target))
                c[0] = int(self.item[c[1]]) if c[1] < c[2] else -1
            cursor = [c for c in cursor if c[0] >= 0]
        return found

    def passages(self, term: np.ndarray, first: np.ndarray, passage: int):
        """(document, first token, distinct terms) of passages that the bounds
        of essential postings and of blocks leave over."""
        half = passage // 2
        size = np.diff(first)
        n_half = -(-size // half)
        base = np.concatenate([[0], np.cumsum(n_half)])
        known = np.flatnonzero(term >= 0)
        if len(known) == 0:
            return
        doc = np.searchsorted(first, known, side="right") - 1
        where = base[doc] + (known - first[doc]) // half
        key = np.unique(where * len(self.terms) + term[known])
        where, t = key // len(self.terms), key % len(self.terms)
        owner = np.repeat(np.arange(len(size)), n_half)
        # Essential impacts by (half passage, item); a passage is two halves.
        n = self.e_start[t + 1] - self.e_start[t]
        at = np.repeat(self.e_start[t], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        half_no, item, impact = np.repeat(where, n), self.e_item[at], self.e_impact[at]
        before = (half_no > 0) & (owner[np.maximum(half_no - 1, 0)] == owner[half_no])
        n_items = len(self.ids)
        cell, which = np.unique(np.concatenate([half_no, half_no[before] - 1]) * n_items
                                + np.concatenate([item, item[before]]), return_inverse=True)
        mass = np.bincount(which, weights=np.concatenate([impact, impact[before]]), minlength=len(cell))
        live = np.unique(cell[mass + self.given[cell % n_items] >= 1 - 1e-9] // n_items)
        for w in live:
            d = int(owner[w])
            stop = w + 1 if w + 1 < base[d + 1] else w
            a, b = np.searchsorted(where, [w, stop + 1])
            distinct = np.unique(t[a:b])
            if self.best_block(distinct) >= 1 - 1e-6:
                yield d, int((w - base[d]) * half), distinct

    def search(self, blk: TextBlock, passage: int, overlap: float):
        """(document, item, score share, question and answer overlap) of leaks."""
        h, first = tokens(blk)
        tried: dict[tuple[int, int], list] = {}
        for d, at, terms in self.passages(self.term_of(h), first, passage):
            for item in self.wand(terms):
                span = tried.setdefault((d, item), [at, at + passage])
                span[1] = max(span[1], at + passage)
        for (d, item), (lo, hi) in sorted(tried.items()):
            length, q, a, whole = self.parts[item]
            text = h[first[d] + max(0, lo - length):min(first[d + 1], first[d] + hi + length)]
            qs, as_, ws = (_share(text, g, min(GRAM, n)) for g, n in (
                (q, length), (a, length), (whole, length)))
            if (qs >= overlap and as_ >= overlap) or ws >= WHOLE_OVERLAP:
                yield d, int(self.ids[item]), qs, as_, ws


def _share(text: np.ndarray, wanted: np.ndarray, n: int) -> float:
    """Share of the wanted n-grams that a token sequence holds."""
    if len(wanted) == 0 or n == 0:
        return 0.0
    have = np.zeros(len(wanted), dtype=bool)
    for k in range(1, n + 1):  # parts below GRAM tokens are one shorter gram
        if k == n or len(wanted) == 1:
            g = grams(text, k)
            have |= np.isin(wanted, g)
    return float(have.mean())


def item_table(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")


def build_indexes(benchmark: DataFrame, block_postings: int = BLOCK_POSTINGS) -> Iterator[Index]:
    """Indexes of blocks of items.  Document frequencies and the mean length
    are of all items; a block's items and terms are within the bound."""
    items = item_table(benchmark)

    def task(batches):
        for batch in batches:
            for blk in text_blocks(batch.column("text")):
                h, first = tokens(blk)
                for a, b in zip(first[:-1], first[1:], strict=True):
                    t = np.unique(h[a:b]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.full(len(t), b - a))],
                                                     names=["term", "length"])

    terms = items.select("text").mapInArrow(task, "term long, length long")
    lengths = items.select(F.octet_length("text").alias("n"), "item_id", "text")
    total = lengths.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not total[0]:
        return
    n_blocks = -(-int(total[1]) // block_postings)  # a token has one byte at least
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def count(batches):
        for batch in batches:
            n = [len(token_hashes(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n"])
    mean = items.select("text").mapInArrow(count, "n long").agg(F.avg("n")).first()[0] or 1.0
    for k in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        rows = sorted((r.item_id if r.item_id is not None else -1, r.text) for r in part.collect())
        mine = part.select("text").mapInArrow(task, "term long, length long").select("term").distinct()
        freq = {r.term: r.df for r in df.join(mine, "term").collect()}
        yield Index(rows, freq, int(total[0]), float(mean))


LEAKS = "doc_id long, item_id long, question_overlap double, answer_overlap double, item_overlap double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, passage: int = PASSAGE, overlap: float = OVERLAP) -> DataFrame:
    """Operator 6: one row per document and benchmark item that it leaks."""
    spark = docs.sparkSession
    out = None
    for index in build_indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def task(batches, shared=shared):
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[blk.row0 + d], *rest) for blk in text_blocks(batch.column("text"))
                        for d, *rest in shared.value.search(blk, passage, overlap)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)],
                                                     names=[c.split()[0] for c in LEAKS.split(", ")])
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, LEAKS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], LEAKS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, passage: int = PASSAGE, overlap: float = OVERLAP) -> DataFrame:
    """The rows of `docs` (all their columns) that leak no item."""
    spark = docs.sparkSession
    for index in build_indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def task(batches, shared=shared):
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for blk in text_blocks(batch.column("text")):
                    for d, *_ in shared.value.search(blk, passage, overlap):
                        clean[blk.row0 + d] = False
                yield batch.filter(pa.array(clean))
        docs = docs.mapInArrow(task, docs.schema)
    return docs
