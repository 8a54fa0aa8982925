"""Operators 1, 2, 3, 5, 8."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import license_scan, mixing, quality, queries, sharding, token_counts

from . import brute
from .conftest import SF


def test_quality_base_columns(odd, odd_rows, docs):
    model = quality.Model(np.zeros(quality.BUCKETS, dtype=np.int64), None)
    for df, rows in ((odd, odd_rows), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
               for r in quality.score_documents(df, model).collect()}
        assert got == {d: brute.base_metrics(t) for d, t in rows}


def test_quality_verdicts_on_labelled_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.quality_rules(docs, labels).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2
    again = {r.doc_id: r.kept for r in quality.quality_rules(docs.repartition(7), labels).collect()}
    assert all(again[r.doc_id] == r.kept for r in rows)


def test_quality_without_labels(odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality_rules(odd, none).collect()
    assert all(r.kept != r.base_failed for r in rows)
    assert quality.keep_good(odd, quality.fit(odd, none)).columns == odd.columns


def test_threshold_place():
    assert quality.place_threshold([5, 6, 7], [1, 2]) in (3, 4, 5)
    assert quality.place_threshold([], [1]) is None


def _encoded(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(token_counts.tokenizer_path())
    return [len(e.ids) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("table_size", [0, 50, token_counts.TABLE_SIZE])
def test_token_counts(spark, docs, odd_rows, table_size):
    extra = [(100, "a<|endoftext|>b <|startoftext|>"), (101, "<|ENDOFTEXT|> <|x"), (102, "don't I'LL we've 12345"),
             (103, "".join(chr(c) for c in range(1, 0x3100) if c not in range(0xD800, 0xE000))),
             (104, "w" * 5000), (105, " ".join(f"a{c}b" for c in "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0      　​﻿"))]
    rows = [*odd_rows, *extra, *((1000 + r.doc_id, r.text) for r in docs.collect())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, table_size=table_size).collect()}
    want = {d: (len((t or "").encode()), n, n > 2048) for (d, t), n in zip(rows, _encoded([t for _, t in rows]), strict=True)}
    assert got == want


def test_mix_targets_and_taken(odd, odd_rows, docs):
    for df in (odd, docs):
        rows = mixing.words_taken(df, block_words=16, lane_rows=50).collect()
        size, taken, target = Counter(), Counter(), {}
        for r in rows:
            size[r.source] += r.size
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert 0 <= r.taken <= 2 * r.size
        want = brute.fair_targets(size)
        for s in size:
            assert target[s] == pytest.approx(want[s], rel=1e-9)
            assert abs(taken[s] - target[s]) <= max(0.02 * target[s], 17)
        assert len(rows) == df.count()
    assert {r.doc_id: r.size for r in mixing.words_taken(odd).collect()} == {d: len(brute.words(t)) for d, t in odd_rows}


def test_mix_reruns_agree(docs):
    a = sorted(map(tuple, mixing.words_taken(docs).collect()))
    assert a == sorted(map(tuple, mixing.words_taken(docs.repartition(9)).collect()))


def test_mix_plan_slots(docs):
    """Every slot of every shard is filled once; a block at most once an epoch."""
    plan = mixing.mix_plan(docs, block_words=64, lane_rows=30)
    blocks = plan.select("shard", "slot", "source", "epoch", "block").distinct()
    rows = blocks.collect()
    assert sorted(r.shard * mixing.SHARD_SLOTS + r.slot for r in rows) == list(range(len(rows)))
    assert max(Counter((r.source, r.epoch, r.block) for r in rows).values()) == 1
    taken = {r.doc_id: r.n for r in plan.groupBy("doc_id").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("n")).collect()}
    got = {r.doc_id: r.taken for r in mixing.words_taken(docs, block_words=64, lane_rows=30).collect() if r.taken}
    assert taken == got


def test_mix_documents_hold_the_words_taken(odd):
    out = mixing.mix_documents(odd, block_words=16, lane_rows=50)
    assert out.columns == odd.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(brute.words(r.text))
        assert r.n_chars == len(r.text)
    assert words == {r.doc_id: r.taken for r in mixing.words_taken(odd, block_words=16, lane_rows=50).collect() if r.taken}


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1000])
def test_permutation_is_one(spark, n):
    df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("x"))
    got = [r.x for r in df.collect()]
    assert sorted(got) == list(range(n))


def test_native_plans_have_no_python(docs):
    for df in (mixing.words_taken(docs), mixing.mix_documents(docs), sharding.assign_shards(docs), license_scan.scan_licenses(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))


def _slow_table(names, size):
    """The claiming rule, read straight: each shard's whole preference list."""
    lists = []
    for s in names:
        a, b = sharding._number(f"offset/{s}") % size, sharding._number(f"skip/{s}") % (size - 1) + 1
        lists.append([(a + i * b) % size for i in range(size)])
    owner, turn = {}, 0
    while len(owner) < size:
        k = turn % len(names)
        owner[next(x for x in lists[k] if x not in owner)] = k
        turn += 1
    return [owner[i] for i in range(size)]


def test_shard_table():
    names = sharding.shard_names(7)
    table = sharding.fill_table(names, 101)
    assert table == _slow_table(names, 101)
    count = Counter(table)
    assert max(count.values()) - min(count.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 101)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 40
    for bad in ((names, 100), ([], 101), (names, 5)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_shards_of_odd_rows(odd, spark):
    out = sharding.assign_shards(odd.withColumn("shard", F.lit("old")))
    assert out.columns == [*odd.columns, "shard"] and out.count() == odd.count()
    same = spark.createDataFrame([(None,), (None,), (3,), (3,)], "doc_id long")
    assert sharding.assign_shards(same).groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_sharding_carries_whole_documents(spark, docs):
    out = queries.QUERIES["op5_sharding_documents"](spark, SF)
    assert out.columns == [*docs.columns, "shard"]
    shard = {r.doc_id: r.shard for r in queries.QUERIES["op5_sharding"](spark, SF).collect()}
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((*r, shard[r.doc_id]) for r in docs.collect()), key=str)


def test_write_shards(docs, tmp_path, spark):
    sharding.write_shards(docs.select("doc_id", "text"), str(tmp_path / "out"), shards=sharding.shard_names(4), size=101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == sorted(r.doc_id for r in docs.collect())


LICENCES = [
    ("Prose. Released under the MIT License. More.", "MIT", "MitName"),
    ("X\nLICENSED under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n"
     "You may obtain a copy of the License at\nhttp://x", "Apache-2.0", "ApacheV2,ApacheComply,ApacheCopy"),
    ("This program is free software; either version 3 of the License, or (at your option) any later version. "
     "This program is distributed in the hope that it will be useful.", "GPL-3.0", None),
    ("No licence here. MIT.", "", ""), (None, "", ""), ("", "", ""),
]


def test_license_rules(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(LICENCES)], "doc_id long, text string")
    for r in license_scan.scan_licenses(df).collect():
        _, want, sequence = LICENCES[r.doc_id]
        assert r.licenses == want
        if sequence is not None:
            assert r.sequence == sequence


MIT_TEXT = """MIT License

Copyright (c) 2020 Somebody

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
"""
GPL_HEADER = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 */"""
BSD_TEXT = """1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
APACHE_HEADER = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in
# compliance with the License. You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0"""
WRAPPED = [
    (MIT_TEXT, "MIT full text"), (GPL_HEADER, "GPL-3.0 header"), (BSD_TEXT, "BSD conditions"),
    (MIT_TEXT.replace("\n", "\r\n"), "MIT full text"), (APACHE_HEADER, "Apache-2.0 header,Apache-2.0 name"),
    ("// SPDX-License-Identifier: MIT\nint x;", "MIT spdx"), ("/* SPDX-License-Identifier: Apache-2.0 */", "Apache-2.0 spdx"),
    ("# SPDX-License-Identifier: GPL-3.0-or-later\n", "GPL-3.0 spdx"),
    ("## License\n\nThis project is licensed under the MIT License - see the [LICENSE](LICENSE) file for details.", "MIT name"),
    ("This library is released under the terms of the\nApache License 2.0.", "Apache-2.0 name"),
    ("Not licensed under the MIT License. The software was useful.", ""), ("A licence\n\nMIT. Reserved rights.", ""),
]


def test_wrapped_licence_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WRAPPED)], "doc_id long, text string")
    got = {r.doc_id: r.rules for r in license_scan.scan_licenses(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(WRAPPED)}


def test_licence_sql_knows_the_same_rules(spark, odd_rows):
    """op3's statement on the hand-made texts, alone and side by side."""
    import duckdb
    import pandas as pd
    texts = [t for t, *_ in (*LICENCES, *WRAPPED)] + [t for _, t in odd_rows]
    texts += ["\n".join(t for t, _ in WRAPPED), " ".join(t for t, _ in WRAPPED), "MIT License\nMIT License\nmit license:\nMIT License."]
    rows = pd.DataFrame({"doc_id": range(len(texts)), "text": texts}, columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", rows)
    want = sorted(con.execute(queries.SQL["op3_license_scan"]).fetchall())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, license_scan.scan_licenses(df).collect())) == want
    assert sum(bool(r[3]) for r in want) >= 14


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracles(spark, name):
    from oracle.compare import compare, duck
    ok, why = compare(queries.QUERIES[name](spark, SF), duck(SF, ["documents"]), queries.SQL[name])
    assert ok, why


def test_empty_tables(nothing, spark):
    assert mixing.words_taken(nothing).count() == 0
    assert mixing.mix_documents(nothing).count() == 0
    assert sharding.assign_shards(nothing).count() == 0
    assert license_scan.scan_licenses(nothing).count() == 0
    assert token_counts.count_tokens(nothing).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(nothing, labels).count() == 0
