"""Token counts (2): map-side two-tier lookup of pre-token lengths.

A text is cut at white space into pre-tokens; the tokenizer never merges
across white space, so a text's token count is the sum of its pre-tokens'.

* Tier 1: a compact table of the most frequent pre-tokens and their lengths,
  at most `table_size` entries, broadcast.  Frequencies come from all
  documents: every task keeps a bounded heavy-hitter summary (Misra-Gries)
  and emits at most `per_task` rows; only these rows are added up by Spark.
  No pre-token stream is shuffled.  The table only saves time: a pre-token
  missing from it is encoded, so counts do not depend on it.
* Tier 2: misses are encoded by the library in batches and kept in a bounded
  cache of the Python worker.

Texts that hold one of the tokenizer's special strings go to the library
whole, so that these strings are handled by its default.

Cases: null text is empty (0 tokens); repeated rows are counted alike; long
pre-tokens (over CACHE_CHARS) are encoded but not cached.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import as_text

TABLE_SIZE = 50_000
PER_TASK = 4_096
SUMMARY_SIZE = 40_000
CACHE_SIZE = 400_000
CACHE_CHARS = 64
TOKEN_LIMIT = 2_048

# Python's str.split() also cuts at these; the tokenizer does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")

_STATE: dict[str, tuple] = {}


def _pieces(text: str) -> list[str]:
    if _NOT_SPACE.search(text):
        return [p for p in _SPACE.split(text) if p]
    return text.split()


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _worker(path: str):
    """Tokenizer, special strings and cache of this Python worker."""
    if path not in _STATE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        with open(path, encoding="utf-8") as f:
            special = [a["content"] for a in json.load(f).get("added_tokens", [])]
        pattern = re.compile("|".join(map(re.escape, special))) if special else None
        _STATE[path] = (tok, pattern, {})
    return _STATE[path]


def _lengths(tok, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def _frequent_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Misra-Gries summary of this task's pre-tokens, counted text by text."""
    summary: Counter = Counter()
    for batch in batches:
        for text in as_text(batch.column("text")).to_pylist():
            summary.update(_pieces(text))
            if len(summary) > 2 * SUMMARY_SIZE:
                cut = sorted(summary.values(), reverse=True)[SUMMARY_SIZE]
                summary = Counter({k: v - cut for k, v in summary.items() if v > cut})
    top = [(k, v) for k, v in summary.most_common(PER_TASK) if len(k) <= CACHE_CHARS and v > 1]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()),
                                      pa.array([v for _, v in top], pa.int64())], names=["piece", "n"])


def frequent_table(docs: DataFrame, path: str, size: int = TABLE_SIZE) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens (at most `size`)."""
    def encode(batches):
        tok = _worker(path)[0]
        for batch in batches:
            piece = batch.column("piece")
            yield pa.RecordBatch.from_arrays(
                [piece, pa.array(_lengths(tok, piece.to_pylist()), pa.int32())], names=["piece", "len"])

    top = (docs.select("text").mapInArrow(_frequent_task, "piece string, n long")
           .groupBy("piece").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "piece").limit(size).select("piece"))
    return {r.piece: r.len for r in top.mapInArrow(encode, "piece string, len int").collect()}


def count_tokens(docs: DataFrame, path: str | None = None, table_size: int = TABLE_SIZE,
                 token_limit: int = TOKEN_LIMIT) -> DataFrame:
    """Operator 2: doc_id, n_bytes, n_tokens, over_limit for every document."""
    path = path or tokenizer_path()
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_table(docs, path, table_size))

    def task(batches):
        tok, special, cache = _worker(path)
        first = table.value
        for batch in batches:
            text = as_text(batch.column("text"))
            counts = np.zeros(len(text), dtype=np.int64)
            waiting: list[tuple[int, str]] = []
            late: dict[str, int] = {}
            for i, t in enumerate(text):
                t = t.as_py()
                if special is not None and "<|" in t and special.search(t):
                    counts[i] = _lengths(tok, [t])[0]
                    continue
                n = 0
                for p in _pieces(t):
                    k = first.get(p)
                    if k is None:
                        k = cache.get(p)
                        if k is None:
                            if len(p) > CACHE_CHARS:
                                k = _lengths(tok, [p])[0]
                            else:
                                late[p] = 0
                                waiting.append((i, p))
                                continue
                    n += k
                counts[i] = n
                if len(waiting) > 20_000:
                    _settle(tok, counts, waiting, late, cache)
            _settle(tok, counts, waiting, late, cache)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(text).cast(pa.int64()), pa.array(counts),
                 pa.array(counts > token_limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        task, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def _settle(tok, counts, waiting, late, cache) -> None:
    """Encode the misses met so far, add them and keep them in the cache."""
    if not waiting:
        return
    keys = list(late)
    late.update(zip(keys, _lengths(tok, keys), strict=True))
    for i, p in waiting:
        counts[i] += late[p]
    if len(cache) + len(late) > CACHE_SIZE:
        cache.clear()
    cache.update(late)
    waiting.clear()
    late.clear()
