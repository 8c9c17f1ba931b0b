"""Drafts against a rule pack and a measured profile: drafts x rules -> findings.

All checks take a table of drafts, so one query lints many. Rule tables and profiles are small
fixed lists and long statistic tables with one row for each register and metric.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text as tx
from .stats import ALL, THIN, long_form

SUBJECT = r"(?i)\A(?:[ \t]*\n)*[ \t]*Subject:[^\n]*(?:\n[ \t]*(?=\n|\z))*\n?"
FINDING = "draft_id, rule_id, severity, observed, expected"


@dataclass(frozen=True)
class Ban:
    id: str
    pattern: str
    kind: str = "phrase"  # word, phrase, regex or char
    severity: str = "warn"
    media: tuple[str, ...] = ("email", "article")


#: A small pack of our own; a project brings its own rules.
BANS = (
    Ban("opening-hope", "I hope this finds you well"),
    Ban("circle-back", "circle back"),
    Ban("at-end-of-day", "at the end of the day", media=("article",)),
    Ban("game-changer", "game-changer", "word", "error"),
    Ban("not-only-but", r"\bnot only\b[^.!?]{1,60}\bbut also\b", "regex"),
    Ban("semicolon", ";", "char", "info"),
    Ban("double-bang", r"!{2,}", "regex", "error"),
)
#: Habits of machine writing, as bans of our own: (id, kind, pattern, a text that breaks it).
HABITS = (
    ("ai-delve", "regex", r"\bdelv(?:e|es|ed|ing) into\b", "We delve into it."),
    ("ai-tapestry", "regex", r"\brich tapestry\b", "A rich tapestry of views."),
    ("ai-testament", "phrase", "stands as a testament", "It stands as a testament to care."),
    ("ai-realm", "phrase", "in the realm of", "In the realm of tax."),
    ("ai-ever-evolving", "regex", r"\bever[- ](?:evolving|changing)\b", "An ever-evolving field."),
    ("ai-fast-paced", "regex", r"\bfast[- ]paced world\b", "In a fast-paced world."),
    ("ai-todays", "regex", r"\bin today['’]s (?:digital|modern|fast)\b", "In today's digital age."),
    ("ai-landscape", "regex", r"\b(?:navigat\w+|evolving) (?:the )?\w* ?landscape\b", "Navigating the market landscape."),
    ("ai-game-changer", "regex", r"\bgame[- ]chang(?:er|ing)\b", "A game-changing idea."),
    ("ai-unlock", "regex", r"\bunlock(?:s|ing)? (?:the|your) (?:full )?potential\b", "Unlock your full potential."),
    ("ai-harness", "regex", r"\bharness(?:es|ing)? the power\b", "Harness the power of data."),
    ("ai-elevate", "regex", r"\belevat(?:e|es|ing) (?:your|the)\b", "Elevate your brand."),
    ("ai-seamless", "word", "seamlessly", "It fits seamlessly."),
    ("ai-cutting-edge", "word", "cutting-edge", "A cutting-edge tool."),
    ("ai-robust", "regex", r"\brobust (?:framework|solution|approach)\b", "A robust solution."),
    ("ai-holistic", "phrase", "holistic approach", "A holistic approach."),
    ("ai-synergy", "regex", r"\bsynerg(?:y|ies)\b", "Find synergies."),
    ("ai-leverage", "regex", r"\bleverag(?:e|es|ing)\b", "We leverage it."),
    ("ai-crucial-role", "regex", r"\bplays? a (?:crucial|vital|pivotal|key) role\b", "It plays a vital role."),
    ("ai-important-note", "regex", r"\bit(?:'s| is) (?:important|worth|crucial) (?:to note|noting)\b", "It is worth noting this."),
    ("ai-conclusion", "regex", r"^In (?:conclusion|summary),", "In conclusion, no."),
    ("ai-ultimately", "regex", r"^Ultimately,", "Ultimately, it works."),
    ("ai-moreover", "regex", r"^(?:Moreover|Furthermore|Additionally),", "Moreover, it works."),
    ("ai-not-just", "regex", r"\b(?:not|n't) just [^.!?\n]{1,60}(?:;|,| —|\.) (?:it's|it is|but)\b", "It's not just a tool, it's a habit."),
    ("ai-not-only", "regex", r"\bnot only\b[^.!?\n]{1,80}\bbut(?: also)?\b", "Not only fast but also cheap."),
    ("ai-whether", "regex", r"^Whether you(?:'re| are)\b[^.!?\n]{1,80}\bor\b", "Whether you're new or not, come."),
    ("ai-imagine", "regex", r"^Imagine (?:a world|if|this)\b", "Imagine a world without it."),
    ("ai-heres", "regex", r"^Here(?:'s| is) (?:the thing|why|what)\b", "Here's the thing."),
    ("ai-lets", "regex", r"^Let(?:'s| us) (?:dive|explore|unpack|break)\b", "Let's dive in."),
    ("ai-truth", "phrase", "the truth is", "The truth is simple."),
    ("ai-journey", "regex", r"\b(?:embark|journey) (?:on|of|toward)", "We embark on it."),
    ("ai-beacon", "phrase", "a beacon of", "A beacon of hope."),
    ("ai-myriad", "regex", r"\ba (?:myriad|plethora|multitude) of\b", "A myriad of ways."),
    ("ai-foster", "regex", r"\bfoster(?:s|ing)? (?:a|an|the|collaboration|trust|growth|innovation)\b", "Fostering trust matters."),
    ("ai-underscore", "regex", r"\bunderscor(?:e|es|ing) the (?:importance|need|value)\b", "It underscores the need."),
    ("ai-transformative", "word", "transformative", "A transformative step."),
    ("ai-hope-finds", "phrase", "hope this email finds you well", "I hope this email finds you well."),
    ("ai-help-further", "regex", r"\bif you(?:'d| would) like(?: me)? to\b", "Say if you'd like me to."),
    ("ai-emphatic-dash", "regex", r"\w — \w[^—\n]{1,80} — \w", "It is — as we know — good."),
    ("ai-bold-lead", "regex", r"^[-*] \*\*[^*\n]+\*\*:", "- **Cost**: low"),
)
HABIT_BANS = tuple(Ban(i, "(?m)" + p if k == "regex" else p, k, "warn", ("email", "article")) for i, k, p, _ in HABITS)
LIMITS = {"email": {"exclamations_max": 1, "emoji_max": 0, "em_dashes_max": 0, "headings_allowed": 0}, "article": {"exclamations_max": 0, "emoji_max": 0, "em_dashes_max": 3}}


def validated(bans: list[dict]) -> list[Ban]:
    """Bans from configuration rows; every fault is reported at once."""
    faults, out = [], []
    for k, b in enumerate(bans):
        if unknown := set(b) - {"id", "pattern", "kind", "severity", "media"}:
            faults.append(f"ban {k}: unknown keys {sorted(unknown)}")
        if b.get("kind", "phrase") not in ("word", "phrase", "regex", "char"):
            faults.append(f"ban {k}: kind {b.get('kind')!r}")
        if b.get("severity", "warn") not in ("error", "warn", "info"):
            faults.append(f"ban {k}: severity {b.get('severity')!r}")
        if not b.get("id") or not b.get("pattern"):
            faults.append(f"ban {k}: id and pattern are needed")
        elif b.get("kind") == "regex":
            try:
                re.compile(b["pattern"])
            except re.error as e:
                faults.append(f"ban {k}: {e}")
        if not faults:
            out.append(Ban(b["id"], b["pattern"], b.get("kind", "phrase"), b.get("severity", "warn"), tuple(b.get("media", ("email", "article")))))
    if len({b.get("id") for b in bans}) < len(bans):
        faults.append("ids repeat")
    if faults:
        raise ValueError("; ".join(faults))
    return out


def without_subject(c: Column) -> Column:
    """The text after a leading subject line and the blank lines that follow it."""
    return F.regexp_replace(c, SUBJECT, "")


def pattern_of(ban: Ban) -> str:
    if ban.kind == "regex":
        return "(?i)" + ban.pattern
    return rf"\Q{ban.pattern}\E" if ban.kind == "char" else tx.phrase(ban.pattern)


def _finding(rule: Column | str, severity: Column | str, observed: Column, expected: Column) -> list[Column]:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return [F.col("draft_id"), lit(rule).alias("rule_id"), lit(severity).alias("severity"), observed.cast("string").alias("observed"), expected.cast("string").alias("expected")]


def bans(drafts: DataFrame, rules=BANS) -> DataFrame:
    """One row for each draft and ban it breaks, with the number of hits."""
    text = F.coalesce("text", F.lit(""))
    hits = F.array(*(F.struct(F.lit("rules." + b.id).alias("rule"), F.lit(b.severity).alias("sev"), F.when(F.col("medium").isin(list(b.media)), F.regexp_count(text, F.lit(pattern_of(b)))).otherwise(0).alias("hits")) for b in rules))
    return drafts.select("draft_id", F.inline(hits)).where("hits > 0").select(*_finding(F.col("rule"), F.col("sev"), F.col("hits"), F.lit(0)))


def locations(drafts: DataFrame, rules=BANS) -> DataFrame:
    """(draft_id, rule_id, line, col, excerpt) of every ban hit. Only single signs are echoed:
    an excerpt could show a name."""
    spots = [F.inline(_places(F.col("text"), pattern_of(b))) for b in rules]
    parts = [drafts.where(F.col("medium").isin(list(b.media))).select("draft_id", F.lit("rules." + b.id).alias("rule_id"), s) for b, s in zip(rules, spots, strict=True)]
    return reduce(DataFrame.unionByName, parts)


def _places(text: Column, pattern: str) -> Column:
    """Line, column and echo of each match, from the lengths of matches and gaps."""
    none = F.expr("cast(array() as array<struct<line:int,col:int,excerpt:string>>)")

    def places(x: Column) -> Column:
        found, gaps = x["m"], x["g"]

        def at(i: Column) -> Column:
            # What stands before match i: gaps up to i with the matches between them.
            parts = F.transform(F.sequence(F.lit(1), i), lambda k: F.concat(F.when(k > 1, F.get(found, k - 2)).otherwise(F.lit("")), F.get(gaps, k - 1)))
            m = F.get(found, i - 1)
            sign = F.when((F.char_length(m) == 1) & ~F.rlike(m, F.lit(r"(?U)\w")), m).otherwise(F.lit(""))
            line = lambda before: F.struct((F.regexp_count(before, F.lit("\n")) + 1).alias("line"), (F.char_length(F.substring_index(before, "\n", -1)) + 1).alias("col"), sign.alias("excerpt"))
            return tx.let(F.array_join(parts, ""), line)

        return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(1), F.size(found)), at)).otherwise(none)

    return tx.let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")), places)


#: Metrics whose band a limit stands for.
LIMITED = {"exclamations_max": ("exclamation_rate", "exclamations_per_email"), "emoji_max": ("emoji_rate",), "em_dashes_max": (), "headings_allowed": ("heading_use",)}


def limit_rows(table: dict = LIMITS) -> list[tuple[str, str | None, str, int]]:
    """(medium, register, limit, most) rows of a table of limits by medium, in which ``registers``
    may have limits of their own; register None stands for all others."""
    out = []
    for medium, held in table.items():
        own = held.get("registers", {})
        shared = {k: v for k, v in held.items() if k != "registers"}
        for register, limits_ in [(None, shared), *((r, shared | x) for r, x in own.items())]:
            # Headings are limited only where they aren't allowed.
            out += [(medium, register, k, int(v)) for k, v in limits_.items() if not (k == "headings_allowed" and v)]
    return out


def _applies(table: dict, medium: str, register: str | None) -> Column:
    named = sorted(table[medium].get("registers", {}))
    of = F.col("register") == register if register else ~F.coalesce(F.col("register").isin(named or [""]), F.lit(False))
    return (F.col("medium") == medium) & of


def limits(drafts: DataFrame, table: dict = LIMITS) -> DataFrame:
    """Exclamation marks, emoji, dashes and headings above the limit of the medium, or of the
    register where it has one of its own."""
    text = F.coalesce("text", F.lit(""))
    seen = {
        "exclamations_max": F.regexp_count(text, F.lit("!")),
        "emoji_max": F.regexp_count(text, F.lit(lex.emoji_class())) + F.regexp_count(text, F.lit(r":\)|;\)|:-\)|:D")),
        "em_dashes_max": F.regexp_count(text, F.lit("—")),
        "headings_allowed": F.exists(tx.heading_lines(without_subject(text)), lambda x: x).cast("int"),
    }
    rows = [F.struct(F.lit("rules." + k).alias("rule"), _applies(table, m, r).alias("on"), seen[k].alias("seen"), F.lit(most).alias("most")) for m, r, k, most in limit_rows(table)]
    return drafts.select("draft_id", F.inline(F.array(*rows))).where("on and seen > most").select(*_finding(F.col("rule"), "error", F.col("seen"), F.col("most")))


def spelling(drafts: DataFrame, british: bool = True) -> DataFrame:
    pairs = [(a, b) if british else (b, a) for _, b, a in lex.VARIANTS]
    rows = F.array(*(F.struct(F.lit(w).alias("wrong"), F.lit(r).alias("right"), tx.phrase_count(F.coalesce("text", F.lit("")), w).alias("hits")) for w, r in pairs))
    return drafts.select("draft_id", F.inline(rows)).where("hits > 0").select(*_finding("rules.spelling", "error", F.col("wrong"), F.col("right")))


def swearing(drafts: DataFrame, tiers: dict[str, list[str]]) -> DataFrame:
    """Words of any tier that the draft's medium doesn't allow, and those never allowed."""
    every, never = sorted({w for ws in tiers.values() for w in ws}), set(tiers.get("never", []))
    text = F.coalesce("text", F.lit(""))
    bad = lambda w: F.lit(w in never) | ~F.col("medium").isin([m for m, ws in tiers.items() if w in ws and m != "never"] or [""])
    rows = F.array(*(F.struct(F.lit(w).alias("w"), (bad(w) & (tx.phrase_count(text, w) > 0)).alias("hit")) for w in every))
    return drafts.select("draft_id", F.inline(rows)).where("hit").select(*_finding("rules.swearing", "error", F.col("w"), F.lit("allowed tier")))


def measured(drafts: DataFrame) -> DataFrame:
    """Drafts with metrics and tells of their body; the subject line is no part of it."""
    return tx.told(tx.measured(tx.prepared(drafts.withColumn("text", without_subject(F.coalesce("text", F.lit("")))))))


def short(values: DataFrame) -> DataFrame:
    return tx.once(values.select("draft_id", "gated", "words"), "gated", "words").where("not gated").select(*_finding("stats.short_draft", "info", F.col("words"), F.lit(80)))


def bands(values: DataFrame, profile: DataFrame, minimum: int = THIN, table: dict | None = None, diverging: DataFrame | None = None, current: DataFrame | None = None) -> DataFrame:
    """Metrics outside p10 to p90 of the register's band. profile: rows of ``distribution``, in
    which thin registers already have the roll-up's band. Metrics that a limit of ``table``
    stands for are not compared. Where a source's metric diverges (register, metric), the band is
    that of the current source (rows of its distribution)."""
    kept = tx.once(values.select("draft_id", "medium", "register", "gated", *tx.METRICS), "gated", *tx.METRICS).where("gated")
    rows = long_form(kept, tx.METRICS, "draft_id", "medium", "register").withColumn("value", F.round("value", 4))
    for medium, register, limit, _ in limit_rows(table) if table else ():
        if LIMITED[limit]:
            rows = rows.where(~F.coalesce(_applies(table, medium, register) & F.col("metric").isin(list(LIMITED[limit])), F.lit(False)))
    keys, held = ["register", "metric"], ["band_p10", "band_p90", "n_gated"]
    at = profile.select(*keys, *held)
    if diverging is not None:
        apart = diverging.select(*keys).distinct().withColumn("apart", F.lit(True))
        own = current.select(*keys, *(F.col(c).alias(f"own_{c}") for c in held))
        both = at.join(apart, keys, "left").join(own, keys, "left")
        at = both.select(*keys, *(F.when(F.coalesce("apart", F.lit(False)), F.col(f"own_{c}")).otherwise(F.col(c)).alias(c) for c in held))
    # One row for each register and metric.
    out = rows.join(F.broadcast(at), keys).where((F.col("n_gated") >= minimum) & ~F.col("value").between(F.col("band_p10"), F.col("band_p90")))
    return out.select(*_finding(F.concat(F.lit("stats."), "metric"), "warn", F.col("value"), F.concat_ws("-", F.col("band_p10").cast("string"), F.col("band_p90").cast("string"))))


def llm_isms(drafts: DataFrame, hits: DataFrame, never_words: int = 50_000) -> DataFrame:
    """Listed terms in a draft: an error where the corpus never uses the term though it is
    large enough to tell, else a warning."""
    basis = hits.where(F.col("register") == ALL).select("term", "hits", "total")
    rows = F.array(*(F.struct(F.lit(t).alias("term"), tx.phrase_count(F.coalesce("text", F.lit("")), t).alias("n")) for t in lex.LLM_ISMS))
    found = drafts.select("draft_id", F.inline(rows)).where("n > 0").join(F.broadcast(basis), "term")
    return found.select(*_finding("lexicon.llm_ism", F.when((F.col("hits") == 0) & (F.col("total") >= never_words), "error").otherwise("warn"), F.col("term"), F.lit("owner wording")))


def tells(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    rows = long_form(values, list(tx.TELLS), "draft_id", "register").where("value is not null").withColumn("value", F.round("value", 4))
    out = rows.join(F.broadcast(thresholds.select("register", "metric", "direction", "threshold")), ["register", "metric"])
    crossed = F.when(F.col("direction") == "max", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return out.where(crossed).select(*_finding(F.concat(F.lit("ai."), "metric"), "warn", F.col("value"), F.col("threshold")))


def fragmentation(values: DataFrame, mean: float = 3.0, single: float = 0.15) -> DataFrame:
    bad = (F.round("paragraph_mean", 4) < mean) | (F.round("single_share", 4) > single)
    shape = values.where("medium = 'article'").select("draft_id", "paragraph_mean", "single_share")
    return tx.once(shape, "paragraph_mean", "single_share").where(bad).select(*_finding("structure.paragraph_fragmentation", "warn", F.round("paragraph_mean", 4), F.lit(mean)))


def structure(values: DataFrame, profile: DataFrame, expected: float = 0.6) -> DataFrame:
    """In e-mail: headings where the register has none, and a greeting or sign-off that the
    register's texts mostly have."""
    mail = values.where(F.col("medium") == "email")
    at = lambda metric, column, name: F.broadcast(profile.where(F.col("metric") == metric).select("register", F.col(column).alias(name)))
    heading = mail.where("heading_use > 0").join(at("heading_use", "p90", "p"), "register").where("p = 0").select(*_finding("structure.heading", "warn", F.lit(1), F.lit(0)))
    out = [heading]
    for name, metric in (("greetings", "greeting_share"), ("signoffs", "signoff_share")):
        out.append(mail.where(F.col(metric) == 0).join(at(metric, "mean", "m"), "register").where(F.col("m") >= expected).select(*_finding(f"structure.{name}", "warn", F.lit("absent"), F.lit("present"))))
    return reduce(DataFrame.unionByName, out)


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("draft_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warn", "info")))


def summary_text(findings: DataFrame, drafts: DataFrame) -> DataFrame:
    """(draft_id, summary): a line for the draft, with its errors and warnings, and one for each
    finding, errors first. A draft has at most one finding for each rule and term."""
    rank = F.array_position(F.lit(["error", "warn", "info"]), F.col("severity"))
    line = F.concat(F.lit("  "), F.rpad("severity", 6, " "), F.lit(" "), "rule_id", F.lit("  "), "observed", F.lit(" ("), "expected", F.lit(")"))
    per = findings.groupBy("draft_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warn")), F.array_sort(F.collect_list(F.struct(rank.alias("rank"), line.alias("line")))).alias("lines"))
    words = drafts.select("draft_id", "register", "medium", tx.n_words(F.coalesce("text", F.lit(""))).alias("words"))
    some = words.join(per, "draft_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    head = F.concat(F.lit("lint: "), F.col("draft_id").cast("string"), F.lit(" (register "), "register", F.lit(", medium "), "medium", F.lit(", "), F.col("words").cast("string"), F.lit(" words): "), n("error"), F.lit(" error, "), n("warn"), F.lit(" warnings"))
    return some.select("draft_id", F.array_join(F.concat(F.array(head), F.coalesce(F.transform("lines", lambda x: x["line"]), F.expr("cast(array() as array<string>)"))), "\n").alias("summary"))
