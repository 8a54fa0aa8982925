"""Operator 4: signature trees, clusters, components."""

import random

import numpy as np
import pytest

from ledgerframe.llm import ngram_join
from ledgerframe.llm.components import components
from ledgerframe.llm.signature_tree import link_components

from . import brute


def _op4(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_copies(df).collect()}


def _groups(labels):
    out = {}
    for i, x in enumerate(labels):
        out.setdefault(int(x), []).append(i)
    return sorted(out.values())


def _plain(sets, side=None):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if side is not None and side[i] == side[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return label


@pytest.mark.parametrize("seed", range(6))
def test_tree_join_against_all_pairs(seed):
    rng = random.Random(seed)
    sets = []
    for _ in range(220):
        if sets and rng.random() < 0.6:
            s = set(rng.choice(sets).tolist())
            for x in rng.sample(sorted(s), rng.randint(0, max(1, len(s) // 6))):
                s.discard(x)
            s |= {rng.getrandbits(64) for _ in range(rng.randint(0, max(1, len(s) // 8)))}
        else:
            s = {rng.getrandbits(64) for _ in range(rng.choice([1, 3, 9, 40, 200]))}
        sets.append(np.array(sorted(s or {rng.getrandbits(64)}), dtype=np.uint64))
    assert _groups(link_components(sets)) == _groups(_plain(sets))
    side = np.array([rng.randint(0, 1) for _ in sets])
    # Across sides: all those links, and none that the whole relation lacks.
    got, need, most = link_components(sets, side), _plain(sets, side), _plain(sets)
    for i in range(len(sets)):
        for j in range(i):
            assert got[i] == got[j] or need[i] != need[j]
            assert got[i] != got[j] or most[i] == most[j]


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    label = {x: x for ab in links for x in ab if ab[0] != ab[1]}
    for _ in range(50):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_similar_sets_share_a_prefix_pair(percent):
    rng = random.Random(percent)
    often = np.sort(np.array([rng.getrandbits(64) for _ in range(400)], dtype=np.uint64))
    for _ in range(3000):
        n = rng.randint(1, 40)
        a = set(rng.sample(often.tolist(), min(n, rng.randint(0, 20)))) | {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), max(1, len(a) - rng.randint(0, 8)))) | {rng.getrandbits(64) for _ in range(rng.randint(0, 5))}
        if a != b and 100 * len(a & b) >= percent * len(a | b):
            x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
            assert np.intersect1d(ngram_join.prefix_pairs(x, often, percent), ngram_join.prefix_pairs(y, often, percent)).size


def test_all_documents(spark, docs):
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert _op4(docs) == brute.near_copies(pairs)


def test_odd_rows(odd, odd_rows):
    assert _op4(odd) == brute.near_copies(odd_rows)


def test_large_cluster_is_joined_in_parts(spark, docs, monkeypatch):
    """The same result when every cluster is far above one task's share."""
    monkeypatch.setattr(ngram_join, "UNIT_SHINGLES", 150)
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    assert _op4(docs) == brute.near_copies(pairs)


def test_keep_one_of_each_group(odd, odd_rows):
    kept = ngram_join.keep_one(odd)
    want = {c for _, c in brute.near_copies(odd_rows).values()}
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_empty_table(nothing):
    assert ngram_join.near_copies(nothing).count() == 0


def test_repeated_and_null_ids(spark):
    t = " ".join("w%d" % i for i in range(30))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (6, "other words")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.near_copies(df).collect()), key=str)
    assert got == [(5, None), (5, None), (6, 6), (None, None)]


def test_keep_one_loses_no_text(spark):
    """Different texts under one doc_id, and under none, all stay; of rows that
    repeat both, one."""
    a, b, c = (" ".join("%s%d" % (x, i) for i in range(30)) for x in "abc")
    rows = [(None, a), (None, b), (5, c), (5, "other words"), (5, c), (6, c), (7, ""), (7, None), (8, " "), (8, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in ngram_join.keep_one(df).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (5, c), (5, "other words"), (7, ""), (7, None), (8, " ")], key=str)


def test_links_of_every_text_under_one_id(spark):
    """Two texts share an id; each is linked with its own near copy."""
    a, b = ([x + str(i) for i in range(100)] for x in "ab")
    rows = [(None, a), (None, b), (3, [*a[:50], "x", *a[51:]]), (4, [*b[:50], "x", *b[51:]])]
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in rows], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.near_copies(df).collect()} == {None}
    assert sorted(r.text.split()[0] for r in ngram_join.keep_one(df).collect()) == ["a0", "b0"]
