"""Operator 11: grouping of spelling variants by permuterm rotations.

*Words.*  Maximal letter runs of every whole text, A-Z lower-cased; one run in
`drop_one_in` (by the checksum of "<doc_id>:<run>") loses one code point, the
typing errors the contract plants.  Tasks count their own words and hand over
partial counts, so the commonest word is a few rows of a shuffle.

*Rotations.*  The word a·c·b with the end mark `$` has the rotation b$a·c: its
prefix b$a is the word without the letter c, told by where it was.  Two words
that differ by one replaced letter there share the prefix; the word a·b, one
letter shorter, has b$a as a whole rotation.  So a word sends one row for each
rotation with its last letter skipped and one for each whole rotation, and
neighbours meet as equal keys.  Keys are sorted and each run of equal keys is
scanned once.  A run holds at most one word per letter of the alphabet (90)
and one whole rotation, whatever the corpus.

*Neighbours.*  In a run all words but the whole rotation are each other's
neighbours, so a count and the two best words give every member its share:
one row a member, not one a pair.  The same deletion can be made at any place
of a letter's run ("aab" to "ab"); only the first place counts.

*Forms and roots.*  A word's form is its commonest neighbour if that is
`dominance` times as common; a form is always commoner than its word, so forms
are chains, followed by pointer jumping: rounds are the logarithm of a chain's
length, which is itself below log2 of the largest count.

Words are known by their rank in code-point order, so rows stay small and ties
are ties of ranks.  Keys above `LONG_KEY` letters are 127-bit polynomial values
of the same letters: the rotations of a run of many thousand letters would be
quadratic.

Defined results: a null text has no words; a null doc_id counts as the empty
string in the checksum; rows that repeat a document count again; an empty table
gives no rows; only doc_id and text are read, so other columns cannot clash; a
very long text is cut into pieces between runs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from .regions import saved

RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MARK = "$"
PIECE = 1 << 20
HELD_WORDS = 200_000
LONG_KEY = 64
_PRIME = (1 << 127) - 1
_BASE = 0x5851F42D4C957F2D14057B7EF767814F % _PRIME

DROP_ONE_IN, MIN_LENGTH, MIN_COUNT, DOMINANCE = 97, 5, 3, 2


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE letters that end between runs."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text) and (rest := RUN.match(text, end)):
            end = rest.end()
        yield text[at:end]
        at = end


def _add_words(doc_id, text: str, drop_one_in: int, min_length: int, held: dict[str, int]) -> None:
    low = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    seed = crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for piece in _pieces(low):
        for run, n in Counter(RUN.findall(piece)).items():
            h = crc32(run.encode(), seed)
            if h % drop_one_in == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= min_length:
                held[run] = held.get(run, 0) + n


def word_counts(docs: DataFrame, drop_one_in: int = DROP_ONE_IN, min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of at least `min_length` code points that occur
    `min_count` times or more."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()),
                                               pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    _add_words(d, text.as_py(), drop_one_in, min_length, held)
                if len(held) >= HELD_WORDS:
                    yield rows()
                    held.clear()
        if held:
            yield rows()
    parts = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(task, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def long_keys(word: str) -> tuple[list[str], list[str]]:
    """The keys of a long word in time linear in it: (one for each skipped
    letter, one for each whole rotation), as length and polynomial value."""
    n = len(word)
    before = [0]
    for c in word:
        before.append((before[-1] * _BASE + ord(c)) % _PRIME)
    power = [1]
    for _ in range(n + 1):
        power.append(power[-1] * _BASE % _PRIME)

    def key(tail_from: int, head_to: int) -> str:
        tail = (before[n] - before[tail_from] * power[n - tail_from]) % _PRIME
        value = (tail * _BASE + ord(MARK)) * power[head_to] + before[head_to]
        return f"{n - tail_from + 1 + head_to}#{value % _PRIME:x}"
    return [key(i + 1, i) for i in range(n)], [key(i, i) for i in range(n + 1)]


def _long_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `rotations` for long words, a batch each."""
    for batch in batches:
        for word, n, r in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "r")), strict=True):
            skipped, whole = long_keys(word)
            skipped = skipped if len(word) >= LONG_KEY else []
            k = len(skipped) + len(whole)
            first = [i == 0 or word[i - 1] != word[i] for i in range(len(skipped))] + [True] * len(whole)
            yield pa.RecordBatch.from_arrays(
                [pa.array(skipped + whole), pa.array([False] * len(skipped) + [True] * len(whole)), pa.array(first),
                 pa.array([r] * k, pa.int64()), pa.array([n] * k, pa.int64())], names=["key", "whole", "first", "r", "n"])


def _short_rotations(word: Column) -> Column:
    """One struct (key, whole, first) for each skipped letter and each whole
    rotation; `first`: the skipped letter begins its letter's run."""
    n = F.length(word)

    def row(key: Column, whole: bool, first: Column) -> Column:
        return F.struct(key.alias("key"), F.lit(whole).alias("whole"), first.alias("first"))

    def turned(tail_from: Column, head: Column) -> Column:
        return F.concat(F.substr(word, tail_from), F.lit(MARK), F.substr(word, F.lit(1), head))
    skipped = F.transform(F.sequence(F.lit(0), n - 1), lambda i: row(
        turned(i + 2, i), False, (i == 0) | (F.substr(word, i, F.lit(1)) != F.substr(word, i + 1, F.lit(1)))))
    whole = F.transform(F.sequence(F.lit(0), n), lambda i: row(turned(i + 1, i), True, F.lit(True)))
    return F.concat(skipped, whole)


def rotations(ranked: DataFrame) -> DataFrame:
    """(key, whole, first, r, n) for ranked words (word, n, r).

    A word of L letters has keys of L (skipped) and L + 1 letters (whole), the
    end mark counted.  Keys from LONG_KEY letters are polynomial values; the
    choice depends on the key's length alone, so that equal keys are equal."""
    short = (ranked.where(F.length("word") < LONG_KEY)
             .select("r", "n", F.explode(_short_rotations(F.col("word"))).alias("k")).select("k.*", "r", "n"))
    # With the words one letter shorter: their whole rotations are long keys.
    long = ranked.where(F.length("word") >= LONG_KEY - 1).mapInArrow(
        _long_rotations, "key string, whole boolean, first boolean, r long, n long")
    return short.unionByName(long)


_RUNS = {"r": pa.int64(), "near": pa.int64(), "best_n": pa.int64(), "best_r": pa.int64()}


def scan_runs(whole: np.ndarray, first: np.ndarray, r: np.ndarray, n: np.ndarray, begin: np.ndarray):
    """Each member's share of its run: (member, neighbours, best neighbour).

    Runs start at `begin`; members are in the order (n descending, r).  A
    skipped rotation's neighbours are the other skipped ones, and the whole
    rotation if its own deletion is the first of its place; the whole
    rotation's neighbours are the skipped ones of that kind."""
    size, at = np.diff(np.append(begin, len(r))), np.arange(len(r))
    run = np.repeat(np.arange(len(begin)), size)
    none = len(r)

    def least(flags: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(np.where(flags, at, none), begin)

    def count(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.int64), begin)
    part, turned = ~whole, whole
    best = least(part)
    second = least(part & (at != best[run]))
    full = least(turned)
    shorter = least(part & first)
    n_part, n_first, has_full = count(part), count(part & first), full < none
    sees_full = part & first & has_full[run]
    near = np.where(part, n_part[run] - 1 + sees_full, n_first[run])
    other = np.where(at == best[run], second[run], best[run])
    pick = np.where(part, np.where(sees_full, np.minimum(other, full[run]), other), shorter[run])
    met = np.flatnonzero(near > 0)
    return met, near[met], pick[met]


def neighbour_shares(keys: DataFrame) -> DataFrame:
    """(r, near, best_n, best_r): a row for each word and run it has neighbours
    in.  Rows are dealt by key and sorted; runs cut by a batch are carried."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def scanned(table: pa.Table, begin: np.ndarray):
            cols = {c: table.column(c).to_numpy() for c in ("whole", "first", "r", "n")}
            met, near, pick = scan_runs(**cols, begin=begin)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (cols["r"][met], near, cols["n"][pick], cols["r"][pick])],
                                              names=list(_RUNS))

        def borders(table: pa.Table) -> np.ndarray:
            key = table.column("key").combine_chunks()
            return np.flatnonzero(np.concatenate([[True], pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)]))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            begin = borders(table)
            if len(begin) > 1:
                yield scanned(table.slice(0, begin[-1]), begin[:-1])
            held = table.slice(begin[-1]).combine_chunks()
        if held is not None:
            yield scanned(held, np.zeros(1, dtype=np.int64))
    ordered = keys.repartition("key").sortWithinPartitions("key", F.desc("n"), "r")
    return ordered.mapInArrow(task, "r long, near long, best_n long, best_r long")


def follow(forms: DataFrame) -> DataFrame:
    """(r, root) for (r, form): forms followed to the last by pointer jumping.

    Each round an open pointer is replaced by its target's own; it is settled
    when the target points nowhere, or its pointer is settled.  Settled rows
    are looked up but join no more, so a root that many words reach is met by
    each of them once."""
    table = saved(forms.select("r", F.col("form").alias("to"), F.lit(False).alias("settled")), "pointers")
    while not (left := table.where("NOT settled")).isEmpty():
        target = table.select(F.col("r").alias("to"), F.col("to").alias("next"), F.col("settled").alias("there"))
        moved = left.join(target, "to", "left").select("r", F.coalesce("next", "to").alias("to"),
                                                       F.coalesce("there", F.lit(True)).alias("settled"))
        table = saved(table.where("settled").unionByName(moved), "pointers")
    return table.select("r", F.col("to").alias("root"))


def spelling_variants(docs: DataFrame, drop_one_in: int = DROP_ONE_IN, min_length: int = MIN_LENGTH,
                      min_count: int = MIN_COUNT, dominance: int = DOMINANCE) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of the corpus, its
    commonest neighbour if `dominance` times as common, and the last of the
    chain of forms."""
    counted = word_counts(docs, drop_one_in, min_length, min_count)
    words = saved(global_row_number(counted, [F.col("word")], "r").drop("_rn_total"), "words")
    shares = neighbour_shares(rotations(words))
    near = shares.groupBy("r").agg(F.sum("near").alias("n_near"),
                                   F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best_r").alias("form"))).alias("best"))
    chosen = saved(
        words.join(near, "r", "left")
        .withColumn("dominated", -F.col("best.less") >= dominance * F.col("n"))
        .select("r", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                F.when(F.col("dominated"), F.col("best.form")).alias("form"),
                F.when(F.col("dominated"), -F.col("best.less")).alias("form_n")), "forms")
    linked = chosen.where("form IS NOT NULL")
    roots = follow(linked.select("r", "form"))
    names = words.select(F.col("r").alias("id"), F.col("word").alias("name"))
    named = (linked.select("r", "form").join(roots, "r")
             .join(names.select(F.col("id").alias("form"), F.col("name").alias("form_word")), "form")
             .join(names.select(F.col("id").alias("root"), F.col("name").alias("root_word")), "root")
             .select("r", "form_word", "root_word"))
    return (chosen.join(named, "r", "left")
            .select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"),
                    "n", "n_near", "form_n"))
