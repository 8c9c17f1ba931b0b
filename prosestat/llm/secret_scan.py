"""Secret scans over a trigram inverted index, in DataFrame functions alone.

Each rule's regex is parsed into a Boolean query of trigrams that every match must hold: an OR
over alternatives of ANDs of trigrams, lower case. The index is a table of postings (gram, key),
one for each of the rules' trigrams in each document, sorted by trigram in every file, so that
a list's rows lie together and other lists are skipped. An alternative's lists are intersected
by document, and only documents in all of them are verified with the rule's regex. A rule
without a mandatory trigram (here: long runs of hex digits) scans every document.

Base kinds are ``assign``, ``access`` and ``hex``; the method adds keys of well-known forms.
Spans count code points, end exclusive, and are whole matches.

A document's key is a hash of its id and text. Keys that collide are verified together, each by
its own text, so a collision costs time and no result; copies of a text have keys of their own,
so no group of copies meets in a task. Candidates are broadcast to the texts while there are at
most ``BROADCAST_ROWS``, and joined by a shuffle beyond.

Defined cases: a null or empty text has no span and the digest of the empty string; rows that
repeat are judged apart; a null doc_id is carried through; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, materialize, release

#: Candidates of 12 bytes each that may be broadcast.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # understood alike by Java, Python and RE2
    ignore_case: bool = False
    group: int = 0  # the group whose length counts
    least: int = 1
    base: bool = True


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40, base=False),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
)


def java_pattern(rule: Rule) -> str:
    """The rule's regex for Java. Only the keywords of ``assign`` ignore case: the rest of it
    has both cases or none already, so the flag may stand for the whole."""
    return ("(?i)" if rule.ignore_case else "") + rule.pattern


def _expand(tree, most: int = 64) -> tuple[list[str], set[str]]:
    """For a parsed regex: the strings that may begin (and end) it when it is a finite set of
    literals, else []; and the needed alternatives. Each alternative is a run of literals with
    \\0 where anything may stand."""
    runs = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            options = [chr(arg)]
        elif name == "SUBPATTERN":
            options = _expand(arg[3], most)[0]
        elif name == "BRANCH":
            options = [x for branch in arg[1] for x in _expand(branch, most)[0]]
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] == arg[1] == 1:
            options = _expand(arg[2], most)[0]
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[:2] == (0, 1):
            options = ["", *_expand(arg[2], most)[0]]
        elif name == "IN" and all(str(x[0]) == "LITERAL" for x in arg) and len(arg) <= 8:
            options = [chr(x[1]) for x in arg]
        else:
            options = ["\0"]
        joined = [a + b for a, b in product(runs, options)]
        runs = joined if len(joined) <= most else [r + "\0" for r in runs]
    return runs, set()


def trigram_query(rule: Rule) -> list[frozenset[str]] | None:
    """Alternatives of mandatory trigrams in lower case; None if one alternative has none, so
    that every document must be scanned."""
    out = set()
    for run in _expand(sre_parse.parse(rule.pattern))[0]:
        low = run.lower()
        grams = frozenset(low[i : i + 3] for i in range(len(low) - 2) if "\0" not in low[i : i + 3] and low[i : i + 3].isascii())
        if not grams:
            return None
        out.add(grams)
    # An alternative that needs more than another one does adds nothing.
    return sorted((a for a in out if not any(b < a for b in out)), key=sorted)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, key, text) of docs, whose columns stay together in ``doc``."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.xxhash64("doc_id", text).alias("key"), text.alias("text"))


def dictionary(rules=RULES) -> list[str]:
    """The trigrams that the rules ask for."""
    return sorted({g for r in rules for alt in trigram_query(r) or () for g in alt})


def postings(rows: DataFrame, rules=RULES) -> DataFrame:
    """(gram, key): the number of each of the dictionary's trigrams that a text holds."""
    # Lowered in a step of its own, once for all trigrams.
    low = rows.select("key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(dictionary(rules)))))
    return low.select("key", F.explode(held).alias("gram"))


def write_index(rows: DataFrame, path: str, rules=RULES) -> DataFrame:
    """The inverted index, written to ``path``."""
    postings(rows, rules).sortWithinPartitions("gram", "key").write.parquet(path)
    return rows.sparkSession.read.schema("key long, gram int").parquet(path)


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(key, hits): the rules, by number as bits, whose trigram query a document satisfies."""
    number = {g: i for i, g in enumerate(dictionary(rules))}
    asks = [(number[g], k, alt, len(grams)) for k, r in enumerate(rules) for alt, grams in enumerate(trigram_query(r) or ()) for g in grams]
    terms = index.sparkSession.createDataFrame(asks, "gram int, rule int, alt int, needed int")  # a row for each trigram asked for
    # A document that stands in as many of an alternative's lists as it has is in all of them.
    met = index.repartition("key").distinct().join(F.broadcast(terms), "gram").groupBy("key", "rule", "alt").agg(F.count("*").alias("n"), F.first("needed").alias("needed")).where("n = needed")
    return met.groupBy("key").agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("hits"))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """Array of structs (start, rank, end) of the rule's matches that are long enough.

    Lengths of the matches and of what lies between them give the places; both functions step
    through the same leftmost matches.
    """
    pattern = F.lit(java_pattern(rule))
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    gaps = F.transform(F.split(text, java_pattern(rule), -1), F.char_length)
    steps = F.zip_with(F.zip_with(matches, gaps, lambda m, g: F.struct(F.char_length(m).alias("m"), g.alias("g"))), counted, lambda x, c: F.struct(x["m"].alias("m"), x["g"].alias("g"), F.char_length(c).alias("c")))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)").alias("found"))

    def add(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["g"]
        one = F.when(s["c"] >= rule.least, F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + s["m"]).alias("end")))).otherwise(F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)"))
        return F.struct((start + s["m"]).alias("at"), F.concat(acc["found"], one).alias("found"))

    # The last gap has no match after it: zip_with pads it with null.
    real = F.filter(steps, lambda s: s["m"].isNotNull())
    return F.aggregate(real, zero, add, lambda acc: acc["found"])


EMPTY = "cast(array() as array<struct<start:int,rank:int,end:int>>)"


def joined(spans: Column, rules=RULES) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc, found): the columns of docs (doc_id, text, ...), and the spans of all rules, an
    array of structs (start, rank, end)."""
    spark = docs.sparkSession
    rows = keyed(docs)
    path = fresh_path(spark, "postings")
    hits = candidates(write_index(rows, path, rules), rules)
    hits, _ = materialize(hits, "candidates")
    release(spark, path)
    if hits.count() <= BROADCAST_ROWS:
        hits = F.broadcast(hits)
    rows = rows.join(hits, "key", "left")
    found = []
    for k, rule in enumerate(rules):
        if trigram_query(rule) is None:
            ok = F.rlike("text", F.lit(long_run(rule)))
        else:
            ok = F.coalesce("hits", F.lit(0)).bitwiseAND(F.lit(1 << k)) != 0
        found.append(F.when(ok, spans_of(F.col("text"), rule, k)).otherwise(F.expr(EMPTY)))
    return rows.select("doc", F.concat(*found).alias("found"))


def long_run(rule: Rule) -> str:
    """A quick test for a character class repeated at least ``least`` times."""
    return re.sub(r"\+$", f"{{{rule.least},}}", rule.pattern) if rule.pattern.startswith("[") else rule.pattern


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): n_assign, n_access, n_hex, base_sha256, spans."""
    rows = find(docs.select("doc_id", "text")).select("doc.doc_id", "found")
    base = [k for k, r in enumerate(RULES) if r.base]

    def of(k: int) -> Column:
        return F.size(F.filter("found", lambda s: s["rank"] == k)).cast("long").alias(f"n_{RULES[k].kind}")

    count = [of(k) for k in base]
    return rows.select("doc_id", *count, F.sha2(joined(F.filter("found", lambda s: s["rank"].isin(base))), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs (columns of documents, and any others) with each span replaced by ``[kind]``;
    overlapping spans are joined into one, named after the first. n_chars is counted again."""
    rows = find(docs).select("doc", "found", F.col("doc.text").alias("text"))
    kinds = F.array(*(F.lit(f"[{r.kind}]") for r in RULES))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["text"], gap, F.get(kinds, s["rank"]))).otherwise(acc["text"]).alias("text"))

    tail = lambda acc: F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text")))
    some = F.size("found") > 0
    rows = rows.select("doc", F.when(some, F.aggregate(F.array_sort("found"), start, step, tail)).alias("clean"))
    new = {"text": F.coalesce("clean", "doc.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("clean").isNull(), F.col("doc.n_chars")).otherwise(F.char_length("clean").cast(docs.schema["n_chars"].dataType))
    return rows.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
