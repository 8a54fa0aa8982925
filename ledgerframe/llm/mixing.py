"""Mixing sources to target weights (1), DataFrame functions only.

1. *Pack*: a source's words are packed into blocks of `block_words`.  A hot
   source is dealt over many lanes (hash of doc_id, about `lane_rows` rows a
   lane), so no window holds a whole source; a lane's last block may be short.
2. *Targets*: min(cap * size, level * weight), the level such that the targets
   add up to `share` times all words (water filling over the source table).
3. *Draw*: a source's target gives it a number of block slots.  A keyed
   permutation of all slots deals them out over output shards of `shard_slots`
   slots: the source counts of a shard are a multinomial draw without
   replacement, so the totals meet the targets exactly.
4. *Map*: slot j of a source is in epoch j div n_blocks and takes the block
   that this epoch's pseudorandom permutation puts at j mod n_blocks.  A block
   is taken once an epoch, so no more than `cap` times.
5. *Join* blocks by (source, index): a key has a few rows, however large the source.

The permutations are swap-or-not shuffles: a bijection on any [0, n), evaluated
per row from hashes, without a sort and without state; reruns agree.

Cases: null text has no words; null source is a source (last); sources without
words get target 0; repeated rows are separate documents; an empty table gives
an empty result; clashing extra columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 128
LANE_ROWS = 1_000
SHARD_SLOTS = 4_096
SLOT_CHUNK = 2_000
ROUNDS = 16
SHARE = 1.5
CAP = 2
# Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Image of x under the permutation of [0, n) that `key` names."""
    def step(v, i):
        mirror = F.pmod(F.xxhash64(F.lit("pivot"), i, *key), n) - v
        mirror = F.when(mirror < 0, mirror + n).otherwise(mirror)
        coin = F.xxhash64(F.lit("coin"), i, F.greatest(v, mirror), *key)
        return F.when(coin.bitwiseAND(F.lit(1)) == 1, mirror).otherwise(v)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the words of each document."""
    return docs.select("doc_id", "source",
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def saved_sizes(sizes: DataFrame) -> DataFrame:
    """The sizes, written to the shared folder: texts are counted once, though
    targets, lanes and segments all start from them."""
    path = scratch_path(sizes.sparkSession, "mix-sizes")
    sizes.write.parquet(path)
    return sizes.sparkSession.read.schema(sizes.schema).parquet(path)


def source_targets(sizes: DataFrame, share: float = SHARE, cap: int = CAP,
                   weights: tuple = WEIGHTS) -> DataFrame:
    """(sid, source, n_docs, source_size, weight, target): one row per source."""
    s = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)),
                                            (F.col("sid") % len(weights) + 1).cast("int")))
    # In order of cap * size / weight the capped sources are a prefix; the
    # level that holds with exactly the rows before this one capped.
    s = s.withColumn("fill", F.lit(cap) * F.col("source_size") / F.col("weight"))
    every = W.orderBy("fill", "sid")
    before = every.rowsBetween(W.unboundedPreceding, -1)
    rest = every.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    s = s.withColumn("level", (share * total - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)))
                     / F.sum("weight").over(rest))
    # The first row whose own cap lies above the level ends the prefix.
    s = s.withColumn("level", F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", "sid", "level")))
                     .over(every.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))["level"])
    cap_size = (cap * F.col("source_size")).cast("double")
    target = F.least(cap_size, F.coalesce(F.col("level") * F.col("weight"), cap_size))
    return s.select(F.col("sid").cast("int").alias("sid"), "source", "n_docs", "source_size", "weight",
                    target.alias("target"))


def placed(sizes: DataFrame, sources: DataFrame, lane_rows: int = LANE_ROWS) -> DataFrame:
    """Each document with its lane, its position there and the words before it."""
    lanes = sources.select("sid", F.col("source").alias("s"), "source_size", "target",
                           F.ceil(F.col("n_docs") / lane_rows).alias("n_lanes"))
    d = sizes.join(lanes, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    d = d.withColumn("lane", F.pmod(F.xxhash64(F.lit("lane"), "doc_id"), F.col("n_lanes")).cast("int"))
    w = W.partitionBy("sid", "lane").orderBy(F.xxhash64(F.lit("order"), "doc_id"), "doc_id", "size")
    return d.select("*", F.row_number().over(w).alias("pos"),
                    (F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("before"))


def lane_offsets(docs_placed: DataFrame, block_words: int) -> DataFrame:
    """(sid, lane, offset, n_blocks): the index of each lane's first block and
    the source's number of blocks."""
    lanes = (docs_placed.groupBy("sid", "lane").agg(F.sum("size").alias("words"))
             .withColumn("blocks", F.ceil(F.col("words") / block_words)))
    w = W.partitionBy("sid").orderBy("lane")
    return lanes.select("sid", "lane", F.sum("blocks").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
                        .alias("n_blocks"),
                        (F.sum("blocks").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("blocks")).alias("offset"))


def draw_slots(sources: DataFrame, lanes: DataFrame, cap: int = CAP, seed: int = 0,
               shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, slot, sid, epoch, block): what every output shard takes."""
    quota = (sources.join(lanes.groupBy("sid").agg(F.max("n_blocks").alias("n_blocks")), "sid")
             .where("n_blocks > 0")
             .withColumn("slots", F.least(F.round(F.col("target") * F.col("n_blocks") / F.col("source_size")).cast("long"),
                                          F.lit(cap) * F.col("n_blocks")))
             .where("slots > 0"))
    by = W.orderBy("sid")
    quota = quota.select("sid", "n_blocks", "slots",
                         (F.sum("slots").over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("slots")).alias("base"),
                         F.sum("slots").over(by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"))
    # Two explosions with a shuffle between them: a hot source's slots are
    # made by many tasks.
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(SLOT_CHUNK).cast("long")))
    # A number of partitions is given: adaptive execution would see a few small
    # rows and give them all to one task.
    n_tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = quota.select("*", chunk.alias("c")).repartition(n_tasks, "sid", "c")
    last = F.least(F.col("c") + SLOT_CHUNK, F.col("slots")) - 1
    slots = chunks.select("*", F.explode(F.sequence(F.col("c"), last)).alias("j"))
    place = permuted(F.col("base") + F.col("j"), F.col("total"), F.lit(seed))
    epoch = F.floor(F.col("j") / F.col("n_blocks")).cast("long")
    block = permuted(F.pmod(F.col("j"), F.col("n_blocks")), F.col("n_blocks"), F.lit(seed), F.col("sid"), F.col("epoch"))
    return (slots.withColumn("epoch", epoch).withColumn("place", place)
            .select(F.floor(F.col("place") / shard_slots).cast("long").alias("shard"),
                    F.pmod(F.col("place"), F.lit(shard_slots)).alias("slot"), "sid", "epoch", block.alias("block")))


def segments(docs_placed: DataFrame, lanes: DataFrame, block_words: int) -> DataFrame:
    """One row per document and block it has words in: the word range of the
    document that the block holds (documents without words: one null block)."""
    first = F.floor(F.col("before") / block_words)
    last = F.floor((F.col("before") + F.col("size") - 1) / block_words)
    span = F.when(F.col("size") > 0, F.sequence(first, last))
    # Both sides of these joins grow with the data: a compressed size must not
    # make one of them a broadcast.
    s = docs_placed.select("*", F.explode_outer(span).alias("b")).join(lanes.hint("merge"), ["sid", "lane"])
    lo = F.greatest(F.col("b") * block_words - F.col("before"), F.lit(0))
    hi = F.least((F.col("b") + 1) * block_words - F.col("before"), F.col("size"))
    return s.withColumn("block", F.col("offset") + F.col("b")).withColumn("word_from", lo).withColumn("word_to", hi)


def _parts(docs: DataFrame, block_words: int, lane_rows: int, seed: int, keep: tuple = ()):
    sizes = saved_sizes(sized(docs))
    sources = source_targets(sizes)
    d = placed(sizes, sources, lane_rows)
    lanes = lane_offsets(d, block_words)
    return d, segments(d, lanes, block_words), draw_slots(sources, lanes, seed=seed)


def mix_plan(docs: DataFrame, block_words: int = BLOCK_WORDS, lane_rows: int = LANE_ROWS, seed: int = 0) -> DataFrame:
    """The mix: (shard, slot, source, epoch, block, doc_id, word_from, word_to)."""
    _, segs, slots = _parts(docs, block_words, lane_rows, seed)
    return segs.where("b IS NOT NULL").join(slots.hint("merge"), ["sid", "block"]).select(
        "shard", "slot", "source", "epoch", "block", "doc_id", "word_from", "word_to")


def words_taken(docs: DataFrame, block_words: int = BLOCK_WORDS, lane_rows: int = LANE_ROWS, seed: int = 0) -> DataFrame:
    """Operator 1's digest: doc_id, size, source, source_size, target, taken."""
    _, segs, slots = _parts(docs, block_words, lane_rows, seed)
    times = slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    got = F.coalesce((F.col("word_to") - F.col("word_from")) * F.col("times"), F.lit(0))
    return (segs.join(times.hint("merge"), ["sid", "block"], "left")
            .groupBy("sid", "lane", "pos")
            .agg(*(F.first(c).alias(c) for c in ("doc_id", "size", "source", "source_size", "target")),
                 F.sum(got).alias("taken"))
            .select("doc_id", "size", "source_size", "target", "taken", "source"))


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, lane_rows: int = LANE_ROWS, seed: int = 0) -> DataFrame:
    """The mix as documents, in the columns of `docs`: one row per document and
    epoch that takes words of it.  A document taken whole keeps its text; of
    others the taken words stay, in order, joined by one space."""
    h = F.xxhash64("text").alias("h")
    same = W.partitionBy("doc_id", "h").orderBy("size", "source")
    sizes = saved_sizes(docs.select("doc_id", "source", h,
                                    F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    sources = source_targets(sizes)
    d = placed(sizes.withColumn("copy", F.row_number().over(same)), sources, lane_rows)
    lanes = lane_offsets(d, block_words)
    slots = draw_slots(sources, lanes, seed=seed)
    taken = (segments(d, lanes, block_words).join(slots.hint("merge"), ["sid", "block"])
             .groupBy("doc_id", "h", "copy", "epoch")
             .agg(F.sort_array(F.collect_list(F.struct("word_from", "word_to"))).alias("ranges"),
                  F.sum(F.col("word_to") - F.col("word_from")).alias("got"), F.first("size").alias("size")))
    # The rows of `docs` ride along as one struct: no column name can clash.
    same = W.partitionBy("doc_id", "h").orderBy("source")
    copies = (docs.select("doc_id", "source", h, F.struct("*").alias("row"))
              .select("*", F.row_number().over(same).alias("copy")))
    source_text = F.col("row")["text"]
    words = F.regexp_extract_all(source_text, F.lit(WORD), F.lit(0))
    part = F.flatten(F.transform("ranges", lambda r: F.slice(words, (r["word_from"] + 1).cast("int"),
                                                             (r["word_to"] - r["word_from"]).cast("int"))))
    text = F.when(F.col("got") == F.col("size"), source_text).otherwise(F.array_join(part, " "))
    t = taken.select(F.col("doc_id").alias("k_doc"), F.col("h").alias("k_h"), F.col("copy").alias("k_copy"),
                     "ranges", "got", "size")
    on = (F.col("doc_id").eqNullSafe(F.col("k_doc")) & (F.col("h") == F.col("k_h")) & (F.col("copy") == F.col("k_copy")))
    out = copies.join(t.hint("merge"), on).select("row", text.alias("mixed"))
    cols = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return out.select(*(cols[c].alias(c) if c in cols else F.col("row")[c].alias(c) for c in docs.columns))
