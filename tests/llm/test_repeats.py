"""Operators 9 and 10, the suffix sorter and the block index."""

import random

import pytest

from ledgerframe.llm import block_dedup, suffix_dedup
from ledgerframe.llm.induced import repeated_starts

from . import brute


def _pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def _op9(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df).collect()}


def _op10(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in block_dedup.remove_later_repeats(df).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_suffix_sorter_against_counting(seed):
    rng = random.Random(seed)
    for _ in range(60):
        letters = rng.choice([b"a", b"ab", b"abc", bytes(range(256)), b"abcdefgh "])
        bodies = []
        for _ in range(rng.randint(1, 6)):
            if bodies and rng.random() < 0.5:
                b = rng.choice(bodies)
                b = b[rng.randint(0, len(b)):] + bytes(rng.choices(letters, k=rng.randint(0, 5)))
            else:
                b = bytes(rng.choices(letters, k=rng.randint(1, 60)))
            if b:
                bodies.append(b)
        cap = rng.choice([2, 3, 5, 8, 20])
        seen = {}
        for b in bodies:
            for i in range(len(b) - cap + 1):
                seen[b[i:i + cap]] = seen.get(b[i:i + cap], 0) + 1
        want = [[i for i in range(len(b) - cap + 1) if seen[b[i:i + cap]] > 1] for b in bodies]
        # A queue memory of 100 bytes sends nearly all tuples through the disk.
        for memory in (100, 1 << 20):
            assert [x.tolist() for x in repeated_starts(bodies, cap, memory)] == want


def test_op9_all_documents(docs):
    assert _op9(docs) == brute.repeats(_pairs(docs))


def test_op9_odd_rows(odd, odd_rows):
    assert _op9(odd) == brute.repeats(odd_rows)


def test_op10_all_documents(docs):
    assert _op10(docs) == brute.later_repeats(_pairs(docs))


def test_op10_odd_rows(odd, odd_rows):
    assert _op10(odd) == brute.later_repeats(odd_rows)


def test_null_and_repeated_ids(spark, odd_rows):
    text = dict(odd_rows)[6]
    twice = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "short")], "doc_id long, text string")
    got = suffix_dedup.remove_repeats(twice).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 0), (False, len(text)), (False, len(text)), (True, len(text))]
    # The null doc_id is the smallest: it keeps its words; the copies do not.
    got = block_dedup.remove_later_repeats(twice).collect()
    assert sorted((r.doc_id is None, r.n_removed) for r in got) == [(False, 0), (False, 400), (False, 400), (True, 0)]


def test_empty_tables(nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0
    assert block_dedup.remove_later_repeats(nothing).count() == 0


@pytest.mark.parametrize("bound", [0, 3])
def test_hot_keys_are_compared_by_rows(spark, docs, odd, odd_rows, monkeypatch, bound):
    """The same results when (nearly) every key counts as hot."""
    monkeypatch.setattr(suffix_dedup, "GROUP_SLICES", bound)
    monkeypatch.setattr(block_dedup, "GROUP_SLICES", bound)
    assert _op9(odd) == brute.repeats(odd_rows) and _op10(odd) == brute.later_repeats(odd_rows)
    pairs = _pairs(docs)
    assert _op9(docs) == brute.repeats(pairs) and _op10(docs) == brute.later_repeats(pairs)


def test_a_passage_in_many_documents(spark, monkeypatch):
    """One passage, each time between other words, and chance likenesses of a
    few letters or words at its ends."""
    monkeypatch.setattr(suffix_dedup, "GROUP_SLICES", 10)
    monkeypatch.setattr(block_dedup, "GROUP_SLICES", 10)
    rng = random.Random(8)
    passage = " ".join("p%d" % rng.randint(0, 999) for _ in range(120))
    rows = []
    for i in range(150):
        left, right = (" ".join("%s%d" % (x, rng.randint(0, 2)) for _ in range(rng.randint(0, 30))) for x in "ab")
        rows.append((i, f"{left} {passage[rng.randint(0, 60):len(passage) - rng.randint(0, 60)]} {right}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _op9(df) == brute.repeats(rows) and _op10(df) == brute.later_repeats(rows)
