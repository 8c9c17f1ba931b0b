"""What the plans compute: texts are read and measured once, and results that depend on it."""

import collections
import contextlib
import re

import pandas as pd
from pyspark.sql import functions as F

from prosestat.functions import lexicons as lex
from prosestat.functions import text as tx
from prosestat.operators import delta, lint, select, stats
from prosestat.plans import registry


@contextlib.contextmanager
def settings(spark, **values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def plan(spark, df, which="executedPlan"):
    fixed = {"spark.sql.adaptive.enabled": "false", "spark.sql.debug.maxToStringFields": "10000", "spark.sql.maxPlanStringLength": "100000000"}
    with settings(spark, **fixed):
        return getattr(df._jdf.queryExecution(), which)().toString().split("\n")


def built(spark, sf, name):
    with settings(spark, **{"spark.sql.adaptive.enabled": "false"}):
        return plan(spark, registry.queries()[name](spark, sf))


def test_texts_are_measured_once(spark, sf):
    cuts = lambda name: sum(x.count(tx.SENTENCE_CUT[-12:]) for x in built(spark, sf, name))
    once = cuts("register_distribution")
    assert once and {cuts(n) for n in ("a04_by_thread_position", "a05_by_source", "a18_contrast", "a22_anchored_article")} == {once}


def test_rows_without_a_source_have_medians(spark):
    rows = [("client", s, float(v), True) for s, at in ((None, 10), ("src2", 20)) for v in range(at, at + 5)]
    df = spark.createDataFrame(rows, "recipient_class string, source string, v double, gated boolean")
    wide = df.select("recipient_class", "source", "gated", *(F.col("v").alias(m) for m in tx.METRICS))
    got = {(r["register"], r["source"]): (r["n"], r["p50"]) for r in stats.distribution(wide, "source").where("metric = 'words'").collect()}
    assert got == {(g, s): (5, m) for g in ("client", stats.ALL) for s, m in ((None, 12), ("src2", 22))}


def test_filters_hold_no_text_expressions(spark):
    df = spark.createDataFrame([(1, "One. Two.\n\nThree.\n\nFour.\n\nFive.", "article", "unknown")], "draft_id long, text string, medium string, register string")
    filters = lambda found: [x for x in plan(spark, found, "optimizedPlan") if "Filter" in x and "regexp_replace" in x]
    found = lint.fragmentation(lint.measured(df))
    assert not filters(found) and [r["draft_id"] for r in found.collect()] == [1]


def test_operations_are_those_of_edits_without_comparing_characters(spark, monkeypatch):
    pairs = spark.createDataFrame([(1, 2, "We go. It is far away now.", "We go and it is far away now."), (1, 3, "One thing here.", "One thing. Here it is."), (2, 2, "Same. Old one.", "Same. New one."), (3, 2, "A b. C d.", "A b.")], "chain_id long, version long, before string, after string")
    cols = ("chain_id", "version", "index", "op")
    want = sorted(tuple(r) for r in delta.edits(pairs).select(*cols).collect())
    assert sorted(tuple(r) for r in delta.operations(pairs).collect()) == want
    assert {op for *_, op in want} == {"join", "split", "replace", "delete"}
    calls = []
    monkeypatch.setattr(delta, "similarity", lambda a, b: calls.append(1) or 0.0)
    frame = pd.DataFrame([(1, 2, ["a b"], ["a c"], ["a b"], ["a c"])], columns=["chain_id", "version", "l", "r", "lk", "rk"])
    assert [len(x) for x in delta._aligned([frame], compared=False)] == [1] and not calls


def test_signatures_shuffle_no_texts(spark, sf):
    found = built(spark, sf, "x15_without_signatures")
    assert sum("FileScan" in x and "documents.parquet" in x and "text:string" in x for x in found) == 2
    assert not any("Exchange hashpartitioning" in x and "text#" in x for x in found)


def test_windows_are_those_of_each_word_looked_at(spark):
    text = "We went to Paris and to the old house by the Sea. [NAME] went on. It is so, Old house it's"
    df = spark.createDataFrame([("client", text), ("client", "one"), ("client", None)], "recipient_class string, text string")
    known, function = set(lex.common_words()), set(lex.FUNCTION_WORDS)
    for size in (2, 3):
        ws = re.findall(tx.WORD, text)
        spans = [ws[i : i + size] for i in range(len(ws) - size + 1)]
        good = [s for s in spans if not any(w[0].isupper() and w.lower() not in known for w in s) and not all(w.lower() in function or w[0] == "[" for w in s)]
        want = collections.Counter(" ".join(s).lower() for s in good)
        got = stats.ngrams(df, size)
        assert {r["phrase"]: r["n"] for r in got.collect()} == want and want
        # Words are looked at before windows are made of them.
        assert not any("slice(" in x for x in plan(spark, got, "optimizedPlan"))


def test_names_side_by_side_are_masked_whole(spark):
    texts = ["Ou Ou Ou", "Ou. Onthe", "a Ou, b", "Oui Ou", "xOu Onthe\nOu"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r["m"] for r in df.select(select.masked(F.col("text"), F.array(F.lit("Ou"), F.lit("Onthe"))).alias("m")).collect()]
    assert got == [re.sub(r"(?<!\w)(?:Onthe|Ou)(?!\w)", "[CAP]", t) for t in texts]
