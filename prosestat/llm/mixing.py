"""Mixing sources to target weights, in blocks of fixed length.

1. Each source's documents, in a fixed order, form one stream of words, cut into blocks of
   ``BLOCK`` words. Offsets come from sums over hash buckets and a running sum within a bucket,
   so a source with a third of all rows is never in one task.
2. Targets share the total by weight, none above ``MAX_REPEATS`` times its source; each source
   gets so many of the output's slots, its quota.
3. Every output shard is ``SHARD_SLOTS`` slots long and draws how many of them each source
   gets: a keyed pseudorandom permutation of all slots deals out the quotas without replacement,
   so a shard's counts are multinomial given the totals, shards vary and the totals don't.
4. The j-th slot of a source takes the block that a keyed pseudorandom permutation of the
   source's block indices gives for j, epoch after epoch, and slots join blocks by index. A
   block is thus used at most ceil(slots / blocks) <= MAX_REPEATS times.

``mixed`` gives the output, (shard, slot, source, block, text); ``mix`` says how many words of
each document it holds, from the same slots; ``repeat`` gives the documents' own share of it.

Defined cases: a null text has size 0 and takes 0; null is a source of its own, the last; an
empty table gives no rows; rows that repeat are separate documents; reruns agree, as nothing
depends on partitioning; other columns are ignored, or kept as they are by ``repeat``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, let, materialize, release, tune

BLOCK = 64
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SHARD_SLOTS = 1024
BUCKET_ROWS = 2000
#: Slots that one task makes.
TASK_SLOTS = 500_000
ROUNDS = 12
SEED = 20_240
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space after it.
SPACED = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def targets(sizes: list[int], weights: list[float], most: int = MAX_REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``most`` times its size, the excess shared
    again by weight among the others."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free, left = set(range(len(sizes))), total
    while free:
        w = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / w > most * sizes[i]}
        if not full:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free or i in full)
        free -= full
    return out


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed pseudorandom permutation of [0, n) at x: swap-or-not rounds, each of which swaps
    x with (k - x) mod n or leaves both, by a keyed bit of the larger; a bijection for any n."""

    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.xxhash64(key, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("long"), swap)


@dataclass(frozen=True)
class Source:
    name: str | None
    words: int
    target: float
    blocks: int
    slots: int


def planned(sized: DataFrame, block: int, weights: tuple) -> list[Source]:
    """One entry for each source, by code point, null last, from (source, size)."""
    stats = sized.groupBy("source").agg(F.sum("size").alias("words")).collect()  # one row for each source
    stats = sorted(stats, key=lambda r: (r["source"] is None, r["source"] or ""))
    words = [int(r["words"]) for r in stats]
    aims = targets(words, [weights[i % len(weights)] for i in range(len(words))])
    blocks = [-(-w // block) for w in words]
    slots = [min(MAX_REPEATS * b, round(t * b / w)) if w else 0 for t, b, w in zip(aims, blocks, words, strict=True)]
    return [Source(r["source"], *x) for r, *x in zip(stats, words, aims, blocks, slots, strict=True)]


def _table(spark, sources: list[Source]) -> DataFrame:
    rows = [(k, s.name, s.words, s.target, s.blocks) for k, s in enumerate(sources)]
    return spark.createDataFrame(rows, "source_no int, source string, source_size long, target double, blocks long")


def placed(sized: DataFrame, sources: list[Source], seed: int) -> DataFrame:
    """sized (row, doc_id, source, size, tie) with source_no, source_size, target and ``at``, the
    row's place in its source's stream of words."""
    table = F.broadcast(_table(sized.sparkSession, sources))  # one row for each source
    rows = sized.join(table, sized["source"].eqNullSafe(table["source"])).drop(table["source"])
    counts = rows.groupBy("source_no").agg(F.ceil(F.count("*") / BUCKET_ROWS).alias("buckets"))
    rows = rows.join(F.broadcast(counts), "source_no").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), F.col("buckets")))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("held"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source_no", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(base, ["source_no", "bucket"])
    return rows.select("row", "doc_id", "source", "source_no", "size", "source_size", "target", (F.col("base") + F.col("inner")).alias("at"))


def slots(spark, sources: list[Source], seed: int = SEED) -> DataFrame:
    """The output's slots: (shard, slot, source_no, block)."""
    ends, total = [], 0
    for s in sources:
        total += s.slots
        ends.append(total)
    rows = spark.range(0, total, 1, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) if total > TASK_SLOTS else 1, -(-total // TASK_SLOTS)))
    deal = permuted(F.col("id"), F.lit(max(total, 1)).cast("long"), F.xxhash64(F.lit(seed), F.lit("deal")))
    at = lambda xs, k: F.get(F.lit([int(x) for x in xs] or [0]), k)

    def place(x: Column, k: Column) -> Column:
        j, n = x - at([0, *ends[:-1]], k), at([max(s.blocks, 1) for s in sources], k).cast("long")
        epoch = F.floor(j / n)  # quotas are at most MAX_REPEATS times the blocks
        held = F.struct((j - epoch * n).alias("j"), n.alias("n"), F.xxhash64(k, epoch, F.lit(seed)).alias("key"))
        return let(held, lambda h: F.struct(k.alias("source_no"), permuted(h["j"], h["n"], h["key"]).alias("block")))

    # The number of ends at or before x is its source: those without slots are stepped over.
    deal = permuted(F.col("id"), F.lit(max(total, 1)).cast("long"), F.lit(seed))
    found = let(deal, lambda x: let(bucket_of(x, ends), lambda k: place(x, k)))
    rows = rows.select(F.expr(f"id div {SHARD_SLOTS}").alias("shard"), F.expr(f"cast(id % {SHARD_SLOTS} as int)").alias("slot"), found.alias("f"))
    return rows.select("shard", "slot", "f.source_no", "f.block")


def pieces(rows: DataFrame, block: int) -> DataFrame:
    """(row, source_no, block, first, n): the words that each row has in each block it touches."""
    last = F.expr(f"(at + size - 1) div {block}")
    spans = rows.where("size > 0").select("row", "source_no", "at", "size", F.explode(F.sequence(F.expr(f"at div {block}"), last)).alias("block"))
    lo = F.greatest(F.col("at"), F.col("block") * block)
    hi = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    return spans.select("row", "source_no", "block", (lo - F.col("at")).alias("first"), (hi - lo).alias("n"), (lo - F.col("block") * block).alias("into"))


def _sized(docs: DataFrame, *keep: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), *keep, F.col("doc_id").cast("long").alias("doc_id"), "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("tie"))


def mix(docs: DataFrame, block: int = BLOCK, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken."""
    spark = docs.sparkSession
    tune(spark)
    sized, sized_at = materialize(_sized(docs), "sized")
    sources = planned(sized, block, weights)
    rows, _ = materialize(placed(sized, sources, seed), "placed")
    release(spark, sized_at)
    used = slots(spark, sources, seed).groupBy("source_no", "block").agg(F.count("*").alias("times"))
    taken = pieces(rows, block).join(used, ["source_no", "block"]).groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("got"))
    return rows.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


def _with_text(docs: DataFrame, block: int, weights: tuple, seed: int) -> tuple[DataFrame, DataFrame, list[Source]]:
    """(rows with their texts and all columns as ``doc``, their places, the sources)."""
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "doc_id", "source", "text")
    base, _ = materialize(_sized(kept, "doc"), "rows")
    sources = planned(base, block, weights)
    rows, _ = materialize(placed(base.drop("doc"), sources, seed).select("row", "source_no", "size", "at"), "placed")
    return base.select("row", "doc"), rows, sources


def mixed(docs: DataFrame, block: int = BLOCK, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mix itself: (shard, slot, source, block, text), one row for each slot. A block's text
    is its words with the white space after them, documents joined by an empty line."""
    spark = docs.sparkSession
    tune(spark)
    base, rows, sources = _with_text(docs, block, weights, seed)
    parts = F.collect_list(F.struct("block", "first", "n", "into"))
    # One row's pieces are as many as its text has blocks.
    cut = pieces(rows, block).groupBy("row", "source_no").agg(parts.alias("parts")).join(base.select("row", F.coalesce("doc.text", F.lit("")).alias("text")), "row")
    words = F.regexp_extract_all("text", F.lit(SPACED), F.lit(0))
    cut = cut.withColumn("_w", words).select("source_no", F.inline(F.transform("parts", lambda p: F.struct(p["block"].alias("block"), p["into"].alias("into"), F.array_join(F.slice(F.col("_w"), (p["first"] + 1).cast("int"), p["n"].cast("int")), "").alias("text")))))
    # A block holds at most ``block`` words.
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("into", "text"))), lambda p: p["text"]), "\n\n")
    packed = cut.groupBy("source_no", "block").agg(text.alias("text"))
    names = _table(spark, sources).select("source_no", "source")
    return slots(spark, sources, seed).join(packed, ["source_no", "block"]).join(F.broadcast(names), "source_no").select("shard", "slot", "source", "block", "text")


def repeat(docs: DataFrame, seed: int = SEED, block: int = BLOCK, weights: tuple = WEIGHTS) -> DataFrame:
    """The mix by documents: of every row as many copies as its most used block has uses, the
    k-th with the words of the blocks that are used k times or more, so that each block's words
    stand in the result exactly as often as the mix takes them. A copy with all its words is the
    text as it is; n_chars, where there is one, is counted again for the others. Rows without
    words take no part in the mix and go."""
    spark = docs.sparkSession
    tune(spark)
    base, rows, sources = _with_text(docs, block, weights, seed)
    used = slots(spark, sources, seed).groupBy("source_no", "block").agg(F.count("*").cast("int").alias("times"))
    part = F.struct("first", "n", "times")
    # One row's pieces are as many as its text has blocks.
    held = pieces(rows, block).join(used, ["source_no", "block"]).groupBy("row").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("times").alias("most"), F.sum("n").alias("words"), F.min("times").alias("least")).join(rows.select("row", "size"), "row")
    copies = held.join(base, "row").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("most"))))
    whole = (F.col("least") >= F.col("k")) & (F.col("words") == F.col("size"))
    words = F.regexp_extract_all(F.coalesce("doc.text", F.lit("")), F.lit(SPACED), F.lit(0))
    wanted = F.filter("parts", lambda p: p["times"] >= F.col("k"))
    cut = F.when(~whole, F.aggregate(F.transform(F.array(words), lambda w: F.transform(wanted, lambda p: F.array_join(F.slice(w, (p["first"] + 1).cast("int"), p["n"].cast("int")), ""))), F.lit(""), lambda a, x: F.concat(a, F.array_join(x, ""))))
    copies = copies.withColumn("cut", cut)
    column = lambda c: {"text": F.coalesce("cut", "doc.text"), "n_chars": F.when(F.col("cut").isNull(), F.col("doc.n_chars")).otherwise(F.char_length("cut").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else None}.get(c, F.col(f"doc.`{c}`"))
    return copies.select(*(column(c).alias(c) for c in docs.columns))
