"""Queries over all rows, held against plain Python on texts that their SQL forms leave out."""

import re

import pytest

from prosestat.functions import lexicons as lex
from prosestat.operators import qual
from prosestat.plans import fixtures, registry

TEXTS = [
    "plain words only",
    "Écrit à anna@société.fr et à bob@example.com",
    "café: x@example.org, y@mail.example",
    "réseau 10.1.2.3 là, é192.168.0.1",
    "hôte 192.168.0.1 fin, 8.8.8.8",
    "naïve patient record",
    "épatient impatients patienté",
    "Hi Zoë,\n\nÇa va? " + "word " * 50,
    "Éric Dupont, Anne-Marie O'Brien, Lefèvre, aÉric Smith-Jones",
    "",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    docs = [(k, t, "fr", f"src{k % 2}", len(t)) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(TEXTS)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    turns = [(1, 0, "user", "first é"), (1, 1, "user", "**second** [a](b)"), (1, 2, "user", "- third"), (2, 0, "user", "alone")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at)


def test_guards_read_every_document(spark, folder):
    email = re.compile(r"[\w.!#$%&'*+/=?^`{|}~-]+@([\w-]+(?:\.[\w-]+)+)")
    real = lambda d: d.lower() not in ("example.com", "example.org", "example.net") and not d.lower().endswith(".example")
    want = {k: any(map(real, email.findall(t))) for k, t in enumerate(TEXTS)}
    got = {r["doc_id"]: r["real_address"] for r in registry.queries()["g03_real_addresses"](spark, folder).collect()}
    assert got == want and want[1]

    def private(t):
        for m in re.finditer(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.])", t):
            a, b, *_ = p = [int(x) for x in m[0].split(".")]
            if max(p) <= 255 and not re.search(r"\b0\d", m[0]) and (a == 10 or (a == 172 and 16 <= b <= 31) or (a == 192 and b == 168)):
                return True
        return False

    want = {k: private(t) for k, t in enumerate(TEXTS)}
    got = {r["doc_id"]: r["private_address"] for r in registry.queries()["g05_private_addresses"](spark, folder).collect()}
    assert got == want and want[3] and want[4]


def test_records_are_read_whole(spark, folder):
    every = sorted([*TEXTS, *fixtures.TEXTS])
    text = {r["record_id"]: r["text"] for r in registry.rows(spark, folder).collect()}
    assert sorted(text.values()) == every
    term = re.compile(r"(?i)(?<!\w)(?:" + "|".join(map(re.escape, lex.SENSITIVE)) + r")(?!\w)")
    got = {r["record_id"]: r["sensitive"] for r in registry.queries()["x22_sensitive"](spark, folder).collect()}
    assert got == {k: bool(term.search(t)) for k, t in text.items()} and sum(got.values()) >= 2
    masked = {"Hi Zoë,": "Hi [NAME],", "Hi Anna,": "Hi [NAME],", "Jane Doe,": "[NAME],"}
    want = {k: next((new + t[len(old) :] for old, new in masked.items() if t.startswith(old)), t) for k, t in text.items()}
    assert {r["record_id"]: r["text"] for r in registry.queries()["x16_greeting_mask"](spark, folder).collect()} == want


def test_names_and_versions_of_every_row(spark, folder):
    token = re.compile(r"\b[A-Z][a-zA-Z]+(?:[-'][A-Z]?[a-z]+)*\b")
    want = {n for t in TEXTS for n in token.findall(t)}
    assert {r["name"] for r in registry.queries()["x19_name_tokens"](spark, folder).collect()} == want
    got = {tuple(r) for r in registry.queries()["j12_version_pairs"](spark, folder).collect()}
    assert got == {(1, 1, "first é", "second a"), (1, 2, "second a", "third")}


def test_absent_quotes_searches_every_span(spark):
    n = 12_000
    drafts = spark.createDataFrame([(k, f'it says "span {k}." here') for k in range(n)], "draft_id long, text string")
    sources = spark.createDataFrame([(" ".join(f"span {k}." for k in range(n) if k % 1000),), ("no span here",), (None,)], "text string")
    got = {tuple(r) for r in qual.absent_quotes(drafts, sources).collect()}
    assert got == {(k, f"span {k}.") for k in range(0, n, 1000)}
    assert qual.absent_quotes(drafts.where("false"), sources).count() == 0
    longer = spark.createDataFrame([(1, 'he wrote "a small grey cat sat" and "no small grey dog sat"; "grey"'), (2, 'and "xsmall grey caty"')], "draft_id long, text string")
    texts = spark.createDataFrame([("xa small\tgrey cat",), ("a small grey cat satisfied",), ("axsmall grey catyz",)], "text string")
    assert {tuple(r) for r in qual.absent_quotes(longer, texts).collect()} == {(1, "no small grey dog sat")}
