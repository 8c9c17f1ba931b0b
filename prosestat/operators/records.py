"""The fact table of texts, its filters and its deduplication."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text as tx


def cut(rows: DataFrame) -> DataFrame:
    """rows with their lineage cut, by a checkpoint in the folder that the cluster names; one of
    their own only in a local session without one."""
    sc = rows.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="prosestat-"))
    return rows.checkpoint()


def record_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 16)


def template_key(text: Column) -> Column:
    """White space collapsed and case folded (as far as lower() folds)."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def records(documents: DataFrame, labels: DataFrame, measure=None) -> DataFrame:
    """documents as records: deterministic stand-ins for what a mailbox would say.

    ``measure``, from a DataFrame with ``text`` to one with more columns, is applied before
    anything is joined, so texts are read, measured and, where no later step asks for them,
    dropped in the stage that scans them.
    """
    pick = lambda names, by: F.get(F.lit(names), by.cast("int"))
    text = F.coalesce("text", F.lit(""))
    d = documents.select(
        record_id(F.col("doc_id").cast("string")).alias("record_id"),
        "doc_id",
        "source",
        (F.regexp_extract("source", r"(\d+)$", 1).try_cast("int") % 2 == 0).alias("eligible"),
        pick(lex.CLASSES, F.col("doc_id") % 8).alias("recipient_class"),
        pick(["new", "reply", "forward"], F.col("doc_id") % 3).alias("thread_position"),
        F.when(F.col("doc_id") % 50 != 0, 2015 + F.col("doc_id") % 10).cast("int").alias("year"),
        (F.col("doc_id") % 11 == 0).alias("inline_reply"),
        (F.col("doc_id") % 7 == 0).alias("has_residual"),
        "text",
        tx.word_count(text).cast("long").alias("word_count"),
        F.sha2(template_key(text), 256).alias("_key"),
    )
    d = measure(d) if measure else d
    marks = labels.groupBy("doc_id").agg((F.min("quality") == 0).alias("low"), (F.max("toxic") == 1).alias("sensitive"))
    d = d.join(marks, "doc_id", "left")
    return d.withColumn("confidence", F.when(F.coalesce("low", F.lit(False)), "low").otherwise("high")).withColumn("sensitive", F.coalesce("sensitive", F.lit(False))).drop("low")


def unique(rows: DataFrame, *order: str) -> DataFrame:
    """The first row of each record_id in the given order, and how many there were."""
    w = Window.partitionBy("record_id")
    return rows.withColumn("seen", F.count("*").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(*order))).where("_rn = 1").drop("_rn")


def templates(rows: DataFrame, least: int = 3) -> DataFrame:
    """template: the same text, case and white space aside, stands in at least ``least`` rows;
    first: the smallest record_id of them that has high confidence.

    Keys are counted before the join, so a text that half of the rows share is one row per task
    in the shuffle; single texts are not joined at all.
    """
    keyed = rows if "_key" in rows.columns else rows.withColumn("_key", F.sha2(template_key(F.coalesce("text", F.lit(""))), 256))
    high = F.col("confidence") != "low" if "confidence" in rows.columns else F.lit(True)
    first = F.min(F.when(high, F.col("record_id"))).alias("first")
    counts = keyed.groupBy("_key").agg(F.count("*").alias("_n"), first).where(F.col("_n") >= least)
    return keyed.join(counts, "_key", "left").withColumn("template", F.col("_n").isNotNull()).drop("_n", "_key")


def merge(parts: list[DataFrame], *order: str) -> DataFrame:
    """Rows of several sources, first wins in the order of the list; templates anew."""
    every = None
    for rank, part in enumerate(parts):
        part = part.withColumn("_rank", F.lit(rank))
        every = part if every is None else every.unionByName(part)
    return templates(unique(every, "_rank", *order).drop("_rank"))


def is_usable() -> Column:
    """Whether a row (of ``templates``) counts in statistics: high confidence, one row for each
    template text."""
    return (F.col("confidence") != "low") & (~F.col("template") | (F.col("record_id") == F.col("first")))


def usable(rows: DataFrame) -> DataFrame:
    return rows.where(is_usable())


def before(rows: DataFrame, cutoff: str) -> DataFrame:
    """Rows dated before the cutoff's year; undated ones don't count as before it."""
    return rows.where(F.col("year") < F.year(F.lit(cutoff).cast("date")))


def phrase_safe(rows: DataFrame) -> DataFrame:
    """Rows whose wording may be shown: eligible source, not sensitive, no residual names."""
    return rows.where(F.col("eligible") & ~F.col("sensitive") & ~F.col("has_residual"))


def exemplar_eligible(least_words: int = 8, most_words: int = 80) -> Column:
    """Whether a row may serve as an example: of an eligible source and high confidence, no
    template, no answers between quoted lines, nothing sensitive and no residual names."""
    bad = F.col("template") | F.col("sensitive") | F.col("inline_reply") | F.col("has_residual")
    return F.col("eligible") & (F.col("confidence") == "high") & ~bad & F.col("word_count").between(least_words, most_words)


def selected(rows: DataFrame, known: list[str], only: list[str]) -> DataFrame:
    """Rows of the sources named in ``only`` (none: all); names that are no source are refused."""
    if unknown := sorted(set(only) - set(known)):
        raise ValueError(f"no such source: {', '.join(unknown)}")
    return rows.where(F.col("source").isin(only)) if only else rows


def refusals(reports: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """(source, reason) of ingest reports (source, status, dumped): a profile must not be built
    over a source whose ingest failed or is partial, or whose dump is older than ``days``."""
    old = F.col("dumped") < now - F.expr(f"interval {days} days")
    reason = F.when(F.col("status").isin("failed", "partial"), F.col("status")).when(F.col("dumped").isNull() | old, F.lit("stale"))
    return reports.select("source", reason.alias("reason")).where("reason is not null")


def checked(reports: DataFrame, now: Column, days: int = 7) -> None:
    """Raise if a source is refused; one row for each source is read."""
    if bad := refusals(reports, now, days).orderBy("source").collect():
        raise ValueError("; ".join(f"{r['source']}: {r['reason']}" for r in bad))


def conserved(seen: DataFrame, kept: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: whether every seen row is either kept or rejected."""
    n = lambda df, c: df.agg(F.count("*").alias(c))
    rows = n(seen, "seen").crossJoin(n(kept, "kept")).crossJoin(n(rejected, "rejected"))  # one row each
    return rows.withColumn("conserved", F.col("seen") == F.col("kept") + F.col("rejected"))


def date_fields(ts: Column, zone: str) -> dict[str, Column]:
    """Local year, weekday (Monday 0) and quarter of the day of a UTC timestamp."""
    local = F.from_utc_timestamp(ts, zone)
    return {"year": F.year(local), "weekday": F.weekday(local), "hour_bucket": F.get(F.lit(["night", "morning", "afternoon", "evening"]), (F.hour(local) / 6).cast("int"))}


def thread_position(subject: Column, answers: Column, rules: Column) -> Column:
    s = F.lower(subject)
    forward = F.rlike(s, F.lit("^fwd?:")) | F.array_contains(rules, "T2")
    cut = F.arrays_overlap(rules, F.lit(["T1", "T3", "T4", "T5", "T6", *(f"H{i}" for i in range(1, 8))]))
    prefix = F.rlike(s, F.lit("^(?:" + "|".join(lex.REPLY_PREFIXES) + ")"))
    return F.when(forward, "forward").when(answers | cut | prefix, "reply").otherwise("new")


def count_bucket(n: Column) -> Column:
    return F.when(n >= 4, "4+").when(n >= 2, "2-3").otherwise("1")


def resolve_recipients(recipients: DataFrame, addresses: DataFrame, domains: DataFrame, orgs: DataFrame, names: DataFrame, threshold: int = lex.GROUP_THRESHOLD) -> DataFrame:
    """Message rows (message_id, recipient_class, count_bucket, stage counts) from recipients
    (message_id, address, display_name) and four mapping tables (key, class).

    An address's domain is exploded into its suffixes, so the longest mapped suffix is found by
    an equi-join and a max, not by comparing every domain with every rule.
    """
    low = recipients.withColumn("address", F.lower(F.coalesce("address", F.lit("")))).withColumn("name", F.lower(F.coalesce("display_name", F.lit("")))).withColumn("rid", F.xxhash64("message_id", "address", "name"))
    smtp = F.contains(F.col("address"), F.lit("@")) & ~F.startswith("address", F.lit("/o="))
    low = low.withColumn("domain", F.when(smtp, F.regexp_extract("address", "@([^@]*)$", 1))).withColumn("org", F.nullif(F.regexp_extract("address", r"(?:^|/)o=([^/]+)", 1), F.lit("")))
    labels = F.split("domain", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = low.where(F.col("domain").isNotNull()).select("rid", F.explode(suffixes).alias("key")).join(domains, "key").groupBy("rid").agg(F.max_by("class", F.char_length("key")).alias("by_domain"))
    out = low.join(hits, "rid", "left")
    for table, column, at in ((addresses, F.when(smtp, F.col("address")), "by_address"), (orgs, F.col("org"), "by_org"), (names, F.col("name"), "by_name")):
        out = out.withColumn("_k", column).join(table.select(F.col("key").alias("_k"), F.col("class").alias(at)), "_k", "left").drop("_k")
    stage = F.when(F.coalesce("by_address", "by_domain").isNotNull(), "smtp").when(F.col("by_org").isNotNull(), "x500").when(F.col("by_name").isNotNull(), "names").otherwise("unknown")
    out = out.withColumn("stage", stage).withColumn("class", F.coalesce("by_address", "by_domain", "by_org", "by_name", F.lit("unknown")))
    rank = F.array_position(F.lit(lex.PRECEDENCE), F.col("class"))
    per = out.groupBy("message_id").agg(F.count("*").alias("n"), F.min(F.when(rank > 0, rank)).alias("rank"), *(F.count_if(F.col("stage") == s).alias(s) for s in ("smtp", "x500", "names", "unknown")))
    best = F.coalesce(F.get(F.lit(lex.PRECEDENCE), (F.col("rank") - 1).cast("int")), F.lit("unknown"))
    return per.select("message_id", F.when(F.col("n") >= threshold, "group").otherwise(best).alias("recipient_class"), count_bucket(F.col("n")).alias("count_bucket"), "smtp", "x500", "names", "unknown")
