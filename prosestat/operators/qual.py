"""Findings of an external reader: grounding, reconciling, merging, linking.

A finding is (finding_no, dimension, register, observation, quote, record_id, confidence).
Exact matches are joins; only what they leave goes to fuzzy matching in Python, and only
within its record or its (dimension, register).
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import records as rec

DIMENSIONS = ["tone", "structure", "vocabulary", "rhythm", "hedging", "humour", "openings", "closings", "argument"]
GROUNDED, BORDERLINE, WINDOW = 0.85, 0.65, 25


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Findings from JSON lines; lines that are no complete object are dropped."""
    schema = "dimension string, register string, observation string, quote string, record_id string, confidence string"
    rows = lines.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("f")).select("f.*")
    return rows.where(F.col("dimension").isin(DIMENSIONS) & F.col("observation").isNotNull() & F.col("quote").isNotNull() & F.col("record_id").isNotNull() & F.col("confidence").isin("high", "medium", "low") & (tx.n_words(F.col("quote")) <= WINDOW))


def best_window(quote: str, text: str, least: float) -> tuple[float, str]:
    """The best character ratio of the quote with a window of up to ``WINDOW`` words, and the
    window; of equal ones the first, and the shorter. Branch and bound: how many characters two
    strings can share at most is known for all windows at once from running counts, and windows
    are compared in the order of that bound until none can be better."""
    if not quote.strip():
        return 0.0, ""
    if quote in text:
        return 1.0, quote
    places = np.array([m.span() for m in re.finditer(r"\S+", text)], np.int64).reshape(-1, 2)
    if not len(places):
        return 0.0, ""
    first = np.repeat(np.arange(len(places)), WINDOW)
    last = first + np.tile(np.arange(WINDOW), len(places))
    first, last = first[last < len(places)], last[last < len(places)]
    start, end = places[first, 0], places[last, 1]
    signs, counts = np.unique(list(quote), return_counts=True)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    shared = np.zeros(len(start), np.int64)
    for sign, n in zip(signs, counts, strict=True):
        held = np.concatenate([[0], np.cumsum(codes == ord(sign))])
        shared += np.minimum(n, held[end] - held[start])
    bound = 2 * shared / (len(quote) + end - start)
    best, at = 0.0, -1
    for k in np.lexsort((np.arange(len(bound)), -bound)).tolist():
        if bound[k] < max(best, least):
            break
        r = SequenceMatcher(None, quote, text[start[k] : end[k]], autojunk=False).ratio()
        if r > best or r == best and k < at:
            best, at = r, k
    return (best, text[start[at] : end[at]]) if at >= 0 else (0.0, "")


def grounded_exact(findings: DataFrame, records: DataFrame) -> DataFrame:
    """Findings whose quote stands in their record."""
    return findings.join(records.select("record_id", "text"), "record_id").where(F.contains("text", F.col("quote"))).drop("text")


def ground(findings: DataFrame, records: DataFrame, least: float = GROUNDED) -> DataFrame:
    """findings with ratio, span and drop reason (null: kept)."""
    rows = findings.join(records.select("record_id", "text"), "record_id", "left")

    @F.pandas_udf("struct<ratio:double,span:string>")
    def fuzzy(quote: pd.Series, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_window(q or "", t or "", least) for q, t in zip(quote, text, strict=True)], columns=["ratio", "span"])

    exact = F.coalesce(F.contains("text", F.col("quote")), F.lit(False))
    near = rows.where(~exact & F.col("text").isNotNull()).withColumn("w", fuzzy("quote", "text"))
    sure = rows.where(exact | F.col("text").isNull()).withColumn("w", F.struct(F.when(F.col("text").isNotNull(), 1.0).otherwise(0.0).alias("ratio"), F.col("quote").alias("span")))
    both = near.unionByName(sure)
    reason = F.when(F.col("text").isNull(), "record_not_in_completed_chunk").when(F.col("w.ratio") < least, "quote_not_grounded")
    return both.select(*findings.columns, F.round("w.ratio", 4).alias("ratio"), F.col("w.span").alias("span"), reason.alias("dropped"))


def normalized(c: Column) -> Column:
    return F.lower(tx.strip(F.regexp_replace(c, r"(?U)\s+", " ")))


def finding_id(*columns: str) -> Column:
    d, r, o = (F.col(c) for c in columns)
    return F.sha2(F.concat_ws("\x00", d, r, normalized(o)), 256)


def ratio(a: str, b: str) -> Column:
    """Similarity of two text columns, from 0 to 1."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "", y or "", autojunk=False).ratio() for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, "double")(a, b)


def reconcile(candidates: DataFrame, prior: DataFrame) -> DataFrame:
    """candidates (finding_no, dimension, register, observation) with status matched,
    borderline or new and the prior finding_id they match."""
    own = candidates.withColumn("_n", normalized(F.col("observation")))
    old = prior.select("dimension", "register", F.col("finding_id").alias("_id"), normalized(F.col("observation")).alias("_o"))
    exact = own.join(old, ["dimension", "register"]).where("_n = _o").groupBy("finding_no").agg(F.min("_id").alias("_exact"))
    rest = own.join(exact, "finding_no", "left_anti").join(old, ["dimension", "register"])
    # Lengths bound the ratio: pairs that can't reach the line are not compared.
    bound = 2 * F.least(F.char_length("_n"), F.char_length("_o")) >= BORDERLINE * (F.char_length("_n") + F.char_length("_o"))
    near = rest.where(bound).withColumn("_r", ratio("_o", "_n")).where(F.col("_r") >= BORDERLINE).groupBy("finding_no").agg(F.max(F.struct("_r", F.col("_id"))).alias("_near"))
    out = own.join(exact, "finding_no", "left").join(near, "finding_no", "left")
    status = F.when(F.col("_exact").isNotNull(), "matched").when(F.col("_near").isNotNull(), "borderline").otherwise("new")
    return out.select(*candidates.columns, status.alias("status"), F.coalesce("_exact", "_near._id").alias("finding_id"))


def merge(findings: DataFrame) -> DataFrame:
    """(finding_id, dimension, register, observation, support, evidence): one row for each
    distinct finding with its set of quotes."""
    rows = findings.withColumn("finding_id", finding_id("dimension", "register", "observation"))
    first = F.min(F.struct("record_id", "quote", "observation", "confidence"))
    return rows.groupBy("finding_id", "dimension", "register").agg(first.alias("f"), F.count_distinct("record_id").alias("support"), F.count_distinct(F.struct("record_id", "quote")).alias("evidence")).select("finding_id", "dimension", "register", F.lower(F.col("f.observation")).alias("observation"), F.col("f.confidence").alias("confidence"), "support", "evidence")


def top_findings(merged: DataFrame, top: int = 80) -> DataFrame:
    rank = F.array_position(F.lit(["high", "medium", "low"]), F.col("confidence"))
    return merged.orderBy(F.col("support").desc(), rank, "finding_id").limit(top).select("finding_id", "support")


def linked(merged: DataFrame) -> DataFrame:
    """Pairs of findings of one dimension whose observations are alike."""
    n = normalized(F.col("observation"))
    a = merged.select("dimension", F.col("finding_id").alias("a"), n.alias("x"))
    b = merged.select("dimension", F.col("finding_id").alias("b"), n.alias("y"))
    pairs = a.join(b, "dimension").where(F.col("a") < F.col("b"))
    bound = 2 * F.least(F.char_length("x"), F.char_length("y")) >= BORDERLINE * (F.char_length("x") + F.char_length("y"))
    return pairs.where(bound).withColumn("r", ratio("x", "y")).where((F.col("x") == F.col("y")) | (F.col("r") >= BORDERLINE)).select("a", "b")


def cross_register(merged: DataFrame, evidence: DataFrame, top: int = 20) -> DataFrame:
    """(group_id, dimension, registers, support, findings): groups of linked findings that span
    two registers or more. Labels spread over the links until they stay; findings are few
    (a bounded number for each register), links only join those of one dimension."""
    links = linked(merged)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).persist()
    label = merged.select(F.col("finding_id").alias("a"), F.col("finding_id").alias("l"))
    while True:
        spread = both.join(label.select(F.col("a").alias("b"), F.col("l").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        new = label.join(spread, "a", "left").select("a", F.least("l", F.coalesce("m", "l")).alias("l"), (F.col("m") < F.col("l")).alias("moved"))
        # Findings are some thousands: written whole each round, so lineage doesn't grow.
        new = rec.cut(new)
        label = new.select("a", "l")
        if not new.where("moved").limit(1).count():
            break
    both.unpersist()
    support = evidence.withColumn("finding_id", finding_id("dimension", "register", "observation")).select("finding_id", "record_id").distinct()
    rows = merged.join(label.withColumnRenamed("a", "finding_id"), "finding_id")
    per = rows.join(support, "finding_id").groupBy("l").agg(F.min("dimension").alias("dimension"), F.count_distinct("register").alias("n_registers"), F.array_join(F.array_sort(F.collect_set("register")), ",").alias("registers"), F.count_distinct("record_id").alias("support"), F.array_sort(F.collect_set("finding_id")).alias("ids"))
    found = per.where("n_registers >= 2").select(F.sha2(F.array_join("ids", "\x00"), 256).alias("group_id"), "dimension", "registers", "n_registers", "support", F.size("ids").alias("findings"))
    return found.orderBy(F.col("n_registers").desc(), F.col("support").desc(), "group_id").limit(top)


def quotes_of(drafts: DataFrame) -> DataFrame:
    """(draft_id, span): distinct quoted spans of a draft, by double, curly or single quotes,
    code marks and block quotes."""
    t = F.col("text")
    kinds = [r'"([^"\n]+)"', "“([^”]+)”", "‘([^’]+)’", r"(?U)(?<!\w)'([^'\n]+)'(?!\w)", r"`([^`\n]+)`", r"(?m)^\s*>\s?(.*)$"]
    spans = F.concat(*(F.regexp_extract_all(t, F.lit(k), F.lit(1)) for k in kinds))
    return drafts.select("draft_id", F.explode(F.array_distinct(spans)).alias("span")).where(F.trim("span") != "")


SPAN_BLOCK = 10_000


def absent_quotes(drafts: DataFrame, sources: DataFrame) -> DataFrame:
    """Quoted spans that stand in no source text.

    A word inside a span, with white space on both sides, is a word of every text that holds
    the span, so the longest such word joins spans with the texts they may stand in. Spans
    without one, of two words or fewer, are sought in every text, a block of them at a time.
    """
    spans = quotes_of(drafts)
    words = F.split("span", r"\s+")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    key = F.array_max(F.transform(inner, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    distinct = spans.select("span").distinct().withColumn("word", F.when(key != "", key))
    long, short = distinct.where("word is not null"), distinct.where("word is null").select("span")
    # Texts that collide in the number are read twice, each for itself.
    texts = sources.where("text is not null").select(F.xxhash64("text").alias("number"), "text")
    held = texts.select("number", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    pairs = held.join(long, "word").select("number", "span").distinct()
    found = texts.join(pairs, "number").where(F.contains("text", F.col("span"))).select("span").distinct()
    blocks = -(-short.count() // SPAN_BLOCK)
    for k in range(blocks):
        # About SPAN_BLOCK spans, broadcast; sources stream past them.
        block = short.where(F.pmod(F.xxhash64("span"), F.lit(blocks)) == k)
        found = found.unionByName(sources.select("text").join(F.broadcast(block), F.contains("text", F.col("span"))).select("span").distinct())
    return spans.join(found, "span", "left_anti").select("draft_id", "span")


def chunk_status(attempts: DataFrame) -> DataFrame:
    """One row: pending, done and failed chunks."""
    return attempts.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "done", "failed")))


def attempted(chunks: DataFrame, results: DataFrame, retries: int = 2) -> DataFrame:
    """chunks (chunk_id, attempts, status) after results (chunk_id, valid)."""
    n = F.col("attempts") + F.when(F.col("valid").isNotNull(), 1).otherwise(0)
    status = F.when(F.col("valid"), "done").when(F.col("valid").isNotNull() & (n > retries), "failed").otherwise(F.col("status"))
    return chunks.join(results, "chunk_id", "left").select("chunk_id", n.alias("attempts"), status.alias("status"))


def planned_words(words: int, chunks_of, most_calls: int = 68) -> int:
    """The sample size, shrunk by tenths until two passes over its chunks stay within the cap."""
    size = words
    while 2 * chunks_of(size) > most_calls:
        if size * 0.9 < words * 0.1:
            raise ValueError(f"no sample of at least a tenth of {words} words fits {most_calls} calls")
        size = int(size * 0.9)
    return size


def dispatched(chunks: DataFrame, reader) -> DataFrame:
    """JSON lines that ``reader`` (a callable from text to an iterator of lines) gives for each
    chunk (chunk_id, text); the reader runs in the executors."""

    def call(batches):
        for pdf in batches:
            rows = [(c, line) for c, t in zip(pdf["chunk_id"], pdf["text"], strict=True) for line in reader(t)]
            yield pd.DataFrame(rows, columns=["chunk_id", "value"])

    return chunks.select("chunk_id", "text").mapInPandas(call, "chunk_id string, value string")


def latest(states: DataFrame) -> DataFrame:
    w = Window.partitionBy("chunk_id").orderBy(F.col("attempts").desc())
    return states.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
