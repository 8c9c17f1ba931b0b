"""Tokens, sentences and metrics against hand-computed numbers and plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from prosestat.functions import lexicons as lex
from prosestat.functions import text as tx
from prosestat.plans import fixtures


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


SENTENCES = [
    ("One. Two! Three?", ["One.", "Two!", "Three?"]),
    ("See e.g. the 3.5 rise. Dr. Who said so.", ["See e.g. the 3.5 rise.", "Dr. Who said so."]),
    ("goes on\nand on", ["goes on and on"]),
    ("ends here\nNext begins", ["ends here", "Next begins"]),
    ("a b\n\nc d", ["a b", "c d"]),
    ("intro:\n- one. two\n- three\nafter", ["intro:", "one. two", "three", "after"]),
    ("1. first\n2. second", ["first", "second"]),
    ("items. Next one.", ["items. Next one."]),
    ("version 1.2.3 is out. Good.", ["version 1.2.3 is out.", "Good."]),
    ("... !!! ???", []),
    ("", []),
]


@pytest.mark.parametrize("text,want", SENTENCES)
def test_sentences(spark, text, want):
    assert one(spark, text, tx.sentences) == want


def test_words(spark):
    assert one(spark, "It’s [NAME]'s café, don't!", tx.words) == ["It's", "[NAME]", "s", "caf", "don't"]
    assert one(spark, "I don't, eh?", tx.word_count) == 3


def test_phrase_counts_agree_with_python(spark):
    for text in ("in fact in fact", "infact in-fact in fact's", "IN FACT\nin fact", "éin fact", ""):
        want = len(re.findall(r"(?<![A-Za-z])in fact(?![A-Za-z])", text, re.I))
        assert one(spark, text, lambda c: tx.phrase_count(c, "in fact")) == want


def test_syllables(spark):
    for word, n in (("table", 2), ("make", 1), ("the", 1), ("queue", 1), ("rye", 1), ("banana", 3), ("[NAME]", 2), ("e", 1)):
        assert one(spark, word, tx.syllables) == n, word


def rows_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r["id"]: r for r in tx.told(tx.measured(tx.prepared(df))).collect()}


def test_structure_and_metrics(spark):
    got = rows_of(spark, fixtures.TEXTS)
    a = got[0]
    assert (a["greeting"], a["signoff"]) == ("Hi [NAME],", "kind regards")
    assert a["body"] == "Could you possibly check this? I'm not sure it's right... Thanks!\n\nSam"
    assert a["words"] == 12 and a["contraction_rate"] == pytest.approx(2 / 12 * 100)
    assert a["question_softener_rate"] == pytest.approx(25) and a["exclamation_rate"] == pytest.approx(25)
    assert a["ellipsis_rate"] == pytest.approx(1000 / 12)
    assert got[1]["greeting"] == "Dear team," and got[9]["greeting"] == "[NAME],"
    b = got[2]
    assert (b["list_use"], b["heading_use"], b["emoji_rate"]) == (1, 1, 2)
    assert b["spaced_dash_rate"] == pytest.approx(3000 / b["words"])
    assert got[3]["heading_use"] == 1
    assert got[10]["words"] == 0 and got[10]["flesch_reading_ease"] == 0
    assert got[11]["signoff_share"] == 1 and got[11]["words"] == 0


def test_tells(spark):
    got = rows_of(spark, fixtures.TEXTS)
    assert got[4]["balanced_openers"] > 0 and got[4]["tricolon_rate"] > 0 and got[4]["negation_contrast_rate"] > 0
    assert got[4]["staccato_runs"] == 2 or got[4]["staccato_runs"] == 3
    assert got[5]["bold_first_bullets"] == 1 and got[5]["heading_density"] > 0
    assert got[6]["service_phrases"] == 4
    assert got[8]["ing_tail_rate"] == pytest.approx(4 / 6 * 100)
    assert got[0]["tricolon_rate"] is None


def python_staccato(lengths):
    def run_from(i):
        fits = [n for n in range(1, len(lengths) - i + 1) if max(w := lengths[i : i + n]) <= 6 and max(w) - min(w) <= 2]
        return max(fits, default=0)

    at = runs = 0
    while at < len(lengths):
        n = run_from(at)
        runs += n >= 3
        at += n if n >= 3 else 1
    return runs


def test_staccato_agrees_with_search(spark):
    import random

    random.seed(7)
    cases = [[random.randint(1, 8) for _ in range(random.randint(0, 14))] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(cases)), "id int, a array<int>")
    got = {r["id"]: r["n"] for r in df.select("id", tx.staccato(F.col("a")).alias("n")).collect()}
    for i, case in enumerate(cases):
        assert got[i] == python_staccato(case), case


def test_anaphora(spark):
    for firsts, n in ((["a", "a", "a"], 1), (["a", "a", "b", "b", "b", "b"], 1), (["we", "we", "we"], 0), ([], 0), (["x", "x", "x", "y", "x", "x", "x"], 2)):
        df = spark.createDataFrame([(firsts,)], "a array<string>")
        assert df.select(tx.anaphora(F.col("a")).alias("n")).first()["n"] == n


def test_lexicons():
    assert len(lex.FUNCTION_WORDS) == 187 and len(lex.EMOJI) == 81 and len(lex.AI_VOCABULARY) == 46
    assert "delve" in lex.LLM_ISMS and len(lex.VARIANTS) == 13
