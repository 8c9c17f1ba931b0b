"""URL filters by rules and by a ratio of character language models, in DataFrame functions.

Rules on host and path decide first, the longest one that fits. The other URLs are judged by
variable-order Markov models of characters, one for accepted and one for rejected URLs: a
character's probability interpolates from the longest context that was seen down to no context
(orders ``ORDER`` to 0), smoothed by the number of different characters that followed. A URL's
score is the mean difference of log-likelihoods per character; it is blocked below a threshold.

Rejected examples are the URLs that a rule blocks or whose host has one of the ``words`` as a
whole word, unless a rule allows them; all others are accepted examples. These labels are never
the verdict: URLs are dealt into ``FOLDS`` folds, a URL is scored by models of the other folds'
URLs alone, and the threshold is calibrated on those scores, so every score, verdict and the
calibration are of URLs that the models were not fitted on. The threshold is the score that
``ACCEPTED`` of the accepted examples' rows reach, so at most the rest of them is blocked.
Counts are taken over all rows of the other folds. Every context with its characters is kept, in tables that grow with the input
and are joined by shuffles; grams of very many lines are salted.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and
is judged by its characters (none: score 0); without examples of both kinds it is allowed;
a score equal to the threshold allows; rows that repeat are judged alike; a null page_id is
carried through; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import looked_up, materialize

ORDER = 4
FOLDS = 5
ACCEPTED = 0.99
START = "\x02"
REJECTED_WORDS = ("casino", "bet", "bets", "betting", "poker", "slots", "adult", "porn", "xxx", "sex", "viagra", "pills", "loan", "loans")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    # Only A-Z are lowered.
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (page_id, url) with host, path, rule and the rule's verdict."""
    rows = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        rule, said = F.when(fits, F.lit(r.name)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(said)
    return rows.withColumn("rule", rule).withColumn("said", said)


def seen(url: Column) -> Column:
    """What the models read: the URL after its scheme, in lower case, with its query and
    without its mark."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^#]*)", 1))


def grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """For each character of ``line``: g, the character with ``order`` before it."""
    padded = F.concat(F.lit(START * order), F.col("line"))
    at = F.when(F.char_length("line") > 0, F.sequence(F.lit(1), F.char_length("line"))).otherwise(F.expr("cast(array() as array<int>)"))
    return rows.withColumn("_p", padded).select(*rows.columns, F.explode(F.transform(at, lambda i: F.substring(F.col("_p"), i, order + 1))).alias("g"))


def model(lines: DataFrame, order: int = ORDER, folds: int = FOLDS) -> DataFrame:
    """From (line, fold, allow, block), a line and its accepted and rejected rows: (g, ratios) for
    every gram g, ratios[f] the log-likelihood difference of g's last character after those
    before it, by the models of all folds but f. Counts of the folds stand side by side, so a
    gram is one row."""
    names = [(x, f"{x}{f}", f) for x in "ab" for f in range(folds)]
    own = {"a": "allow", "b": "block"}
    full = grams(lines.select("line", "fold", "allow", "block"), order).groupBy("g").agg(*(F.sum(F.when(F.col("fold") == f, F.col(own[x])).otherwise(0)).alias(n) for x, n, f in names))
    full, _ = materialize(full, "grams")
    # What is left of all folds' counts without fold f's own.
    rest = {n: sum((F.col(m) for y, m, _ in names if y == x), F.lit(0)) - F.col(n) for x, n, _ in names}
    tail = None
    for k in range(order + 1):
        rows = full.select(F.expr(f"right(g, {k + 1})").alias("g"), *(n for _, n, _ in names)).groupBy("g").agg(*(F.sum(n).alias(n) for _, n, _ in names))
        rows = rows.select("g", F.expr(f"left(g, {k})").alias("c"), *(rest[n].alias(n) for _, n, _ in names))
        context = rows.groupBy("c").agg(*(F.sum(n).alias(f"t{n}") for _, n, _ in names), *(F.count_if(F.col(n) > 0).alias(f"d{n}") for _, n, _ in names))
        rows = rows.join(context, "c")
        if tail is None:
            # Below the empty context lies an even spread over 256 characters.
            rows = rows.withColumns({f"l{n}": F.lit(1 / 256) for _, n, _ in names})
        else:
            rows = rows.withColumn("s", F.expr(f"right(g, {k})")).join(tail.withColumnsRenamed({"g": "s"} | {f"p{n}": f"l{n}" for _, n, _ in names}), "s")
        kinds = lambda n: F.greatest(F.col(f"d{n}"), F.lit(1))
        tail = rows.select("g", *(((F.col(n) + kinds(n) * F.col(f"l{n}")) / (F.col(f"t{n}") + kinds(n))).alias(f"p{n}") for _, n, _ in names))
    return materialize(tail.select("g", F.array(*(F.ln(F.col(f"pa{f}") / F.col(f"pb{f}")) for f in range(folds))).alias("ratios")), "model")[0]


def scores(lines: DataFrame, table: DataFrame, order: int = ORDER) -> DataFrame:
    """(id, score) of the model's own lines (id, fold, line): the mean ratio per character. All
    their grams are in the table."""
    rows = grams(lines.select("id", "fold", "line"), order).groupBy("id", "fold", "g").agg(F.count("*").alias("n"))
    total = lines.agg(F.sum(F.char_length("line"))).first()[0] or 0
    # Some grams stand in nearly every line. Whole numbers add up alike in any order.
    found = looked_up(rows, table, "g", "id", total).withColumn("ratio", F.round(F.get("ratios", F.col("fold")) * 1e9).cast("long"))
    return found.groupBy("id").agg((F.sum(F.col("ratio") * F.col("n")) / F.sum("n") / 1e9).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The least score that is allowed, from (score, allow, block); all are without examples of
    both kinds."""
    # Scores by thousandths: a bounded number of rows, as ratios are bounded.
    at = F.round(F.col("score") * 1000).cast("long").alias("at")
    held = scored.groupBy(at).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).orderBy("at").collect()
    n, m = sum(r["allow"] for r in held), sum(r["block"] for r in held)
    if not n or not m:
        return float("-inf")
    below = 0
    for r in held:
        below += r["allow"]
        if below > (1 - ACCEPTED) * n:
            return r["at"] / 1000
    return float("-inf")


def judge(pages: DataFrame, rules=RULES, words: tuple = REJECTED_WORDS, folds: int = FOLDS) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict, score."""
    rows = ruled(pages.select("page_id", "url"), rules).withColumn("line", seen(F.col("url")))
    parts = F.split("host", r"[^a-z]+")
    label = F.coalesce("said", F.when(F.arrays_overlap(parts, F.lit(list(words))), F.lit("block")), F.lit("allow"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("line"), F.lit(folds)).cast("int"))
    lines = rows.groupBy("line", "fold").agg(*(F.count_if(label == s).alias(s) for s in ("allow", "block"))).withColumn("id", F.monotonically_increasing_id())
    # Written, so ids stay.
    lines, _ = materialize(lines, "lines")
    found = lines.join(scores(lines, model(lines, folds=folds)), "id", "left")
    scored, _ = materialize(found.select("line", "fold", "allow", "block", F.coalesce("score", F.lit(0.0)).alias("score")), "scored")
    least = threshold(scored)
    out = rows.join(scored.select("line", "fold", "score"), ["line", "fold"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= least, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"), "score")
