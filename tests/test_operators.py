"""Deduplication, statistics, selection, edits, findings, guard, extraction and sources."""

import math
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from prosestat import config
from prosestat.operators import delta, extract, guard, lint, qual, records as rec, select, stats
from prosestat.plans import registry
from prosestat.sources import mail
from prosestat.streaming import ingest


def test_first_wins_whatever_the_partitions(spark):
    random.seed(2701)
    rows = [(f"id{random.randint(0, 60)}", s, k) for s in (0, 1) for k in range(100)]
    want = {}
    for i, s, k in rows:
        want.setdefault(i, (s, k))
    df = spark.createDataFrame(rows, "record_id string, rank int, k int")
    for n in (1, 5):
        got = rec.unique(df.repartition(n), "rank", "k").collect()
        assert {r["record_id"]: (r["rank"], r["k"]) for r in got} == want
        assert sum(r["seen"] for r in got) == len(rows)


def test_templates(spark):
    df = spark.createDataFrame([("a", "Same  text"), ("b", "same text "), ("c", "SAME\ntext"), ("d", "other"), ("e", None)], "record_id string, text string")
    assert {r["record_id"] for r in rec.templates(df).where("template").collect()} == {"a", "b", "c"}


def test_recipients(spark):
    to = spark.createDataFrame([("m1", "A@x.corp.example.com", ""), ("m1", "", "Ann"), ("m2", "b@corp.example.com", ""), ("m3", None, None), *[("m4", f"u{k}@z.org", "") for k in range(4)], ("m5", "/o=Org/cn=x", "")], "message_id string, address string, display_name string")
    table = lambda rows: spark.createDataFrame(rows, "key string, class string")
    got = rec.resolve_recipients(to, table([("b@corp.example.com", "personal")]), table([("example.com", "vendor"), ("corp.example.com", "client")]), table([("org", "colleague")]), table([("ann", "cold")]))
    by = {r["message_id"]: (r["recipient_class"], r["count_bucket"]) for r in got.collect()}
    assert by == {"m1": ("cold", "2-3"), "m2": ("personal", "1"), "m3": ("unknown", "1"), "m4": ("group", "4+"), "m5": ("colleague", "1")}


def test_keyness(spark):
    a, ta, b, tb = 10, 100, 5, 300
    whole, both = ta + tb, a + b
    want = 2 * sum(o * math.log(o / e) for o, e in ((a, both * ta / whole), (ta - a, (whole - both) * ta / whole), (b, both * tb / whole), (tb - b, (whole - both) * tb / whole)))
    row = spark.range(1).select(stats.keyness(*(F.lit(float(x)) for x in (a, ta, b, tb))).alias("k"), stats.keyness(F.lit(1.0), F.lit(5.0), F.lit(0.0), F.lit(0.0)).alias("z")).first()
    assert row["k"] == pytest.approx(want) and row["z"] == 0


def test_distribution_is_exact_and_falls_back(spark):
    rows = [("client", float(v), v % 2 == 0) for v in range(11)] + [("vendor", 100.0, True)]
    df = spark.createDataFrame(rows, "recipient_class string, v double, gated boolean")
    from prosestat.functions import text as tx

    wide = df.select("recipient_class", "gated", *(F.col("v").alias(m) for m in tx.METRICS))
    got = {(r["register"], r["metric"]): r for r in stats.distribution(wide, minimum=3).collect()}
    c = got["client", "words"]
    assert [c[f"p{p}"] for p in (10, 25, 50, 75, 90)] == [1, 2.5, 5, 7.5, 9] and not c["fallback_global"]
    v = got["vendor", "words"]
    assert v["fallback_global"] and v["n_gated"] == 7 and v["n"] == 1
    assert got["_global", "words"]["n"] == 12


def test_apportion():
    assert select.apportion([10, 20, 30], 6, [0, 0, 0]) == [1, 2, 3]
    assert select.apportion([5, 1, 1], 5, [1, 1, 1]) == [3, 1, 1]
    assert sum(select.apportion([100, 3, 50], 20, [2, 2, 2])) == 20
    with pytest.raises(ValueError):
        select.apportion([5, 5], 1, [1, 1])


def test_sample_skips_and_goes_on(spark):
    random.seed(3)
    rows = [(f"r{k}", "s", "client", random.choice([1, 40, 60, 90]), True, "high", False, False) for k in range(80)]
    df = spark.createDataFrame(rows, "record_id string, source string, recipient_class string, word_count long, eligible boolean, confidence string, template boolean, sensitive boolean")
    import hashlib

    used, want = 0, set()
    for r in sorted(rows, key=lambda r: hashlib.sha256(r[0].encode()).hexdigest()):
        if used + r[3] <= 500:
            used += r[3]
            want.add(r[0])
    assert {r["record_id"] for r in select.sample(df, words=500).collect()} == want


def test_exemplars_are_spread_and_deterministic(spark, sf):
    rows = registry.templated(spark, sf)
    a, b = (sorted(map(tuple, select.exemplars(rows.repartition(n)).collect())) for n in (1, 6))
    assert a == b and all(r[4] <= 80 for r in a)


def test_masked(spark):
    df = spark.createDataFrame([("Ann-Lee met Ann. Annex", ["Ann", "Ann-Lee"]), ("none", [])], "t string, r array<string>")
    assert [r["x"] for r in df.select(select.masked(F.col("t"), F.col("r")).alias("x")).collect()] == ["[CAP] met [CAP]. Annex", "none"]


def classified(spark, op, left, right):
    """One change, tagged: op, tags and swaps."""
    keys = ([str(k) for k in range(len(x))] for x in (left, right))
    lk, rk = (list(map(str, x)) for x in keys)
    pair = pd.DataFrame([(1, 2, left, right, ["L" + k for k in lk], ["R" + k for k in rk])], columns=["chain_id", "version", "l", "r", "lk", "rk"])
    rows = list(next(delta._aligned([pair])).itertuples(index=False, name=None))
    assert [r[3] for r in rows] == [op]
    r = delta.tagged(spark.createDataFrame(rows, delta.CHANGE)).first()
    return r["op"], r["tags"], [tuple(x) for x in r["swaps"]]


def test_edit_tags(spark):
    op, tags, swaps = classified(spark, "replace", ["I think we should utilise it — now."], ["We should use it - now."])
    assert op == "replace" and {"em_dash_removed", "em_dash_to_spaced_hyphen", "hedge_removed", "llm_ism_removed"} <= set(tags)
    assert ("utilise", "use") in swaps
    assert classified(spark, "replace", ["One two three.", "Four five six."], ["One two three, four five six."])[:2] == ("join", ["join", "sentence_joined_comma"])
    assert classified(spark, "replace", ["One two three four."], ["One two.", "Three four."])[0] == "split"
    assert classified(spark, "replace", ["I do not know this."], ["I don't know this."])[1] == ["contraction"]
    assert classified(spark, "replace", ["abc def"], ["xyz uvw rst"])[1] == []
    got = spark.createDataFrame([("They won't and can't, it's",)], "t string").select(delta.expanded(F.col("t")).alias("x")).first()["x"]
    assert got == ["they", "will", "not", "and", "can", "not", "it", "is"]


def test_edits_over_chains(spark):
    rows = [(1, 1, "Hello there. This is fine.", "llm"), (1, 2, "Hello there. This is good.", "llm"), (1, 3, "Hello there. This is good. More.", "llm")]
    found = delta.edits(delta.version_pairs(spark.createDataFrame(rows, "chain_id long, version long, text string, origin string"))).collect()
    assert [(r["version"], r["op"]) for r in sorted(found, key=lambda r: r["version"])] == [(2, "replace"), (3, "insert")]


def test_normalized_markdown(spark):
    text = "---\ntitle: x\n---\n<!-- c -->\n- **bold** [link](u) ![alt](v)\n2. _em_"
    got = spark.createDataFrame([(text,)], "t string").select(delta.normalized(F.col("t")).alias("x")).first()["x"]
    assert got == "bold link [image: alt]\nem"


def test_ground():
    text = "The quick brown fox jumps over the lazy dog near the river bank"
    assert qual.best_window("brown fox", text, 0.85) == (1.0, "brown fox")
    ratio, span = qual.best_window("quick brown fax jumps", text, 0.85)
    assert ratio > 0.9 and span == "quick brown fox jumps"
    assert qual.best_window("nothing like it at all", text, 0.85)[0] < 0.85
    assert qual.best_window(" ", text, 0.85) == (0.0, "")
    # Against every window.
    from difflib import SequenceMatcher

    spans = [m.span() for m in re.finditer(r"\S+", text)]
    for quote in ("the lazy cat near a river", "jumps ower the layz dog", "fox jumps over", "qqq"):
        every = [(SequenceMatcher(None, quote, text[s:e], autojunk=False).ratio(), text[s:e]) for i, (s, _) in enumerate(spans) for _, e in spans[i : i + qual.WINDOW]]
        best = max(r for r, _ in every)
        want = next((r, w) for r, w in every if r == best)
        assert qual.best_window(quote, text, 0.5) == (want if best >= 0.5 else (0.0, ""))


def test_reconcile_and_link(spark):
    cols = "finding_no long, dimension string, register string, observation string, quote string, record_id string, confidence string"
    prior = qual.merge(spark.createDataFrame([(1, "tone", "client", "Uses short direct sentences", "q", "r1", "high")], cols))
    new = spark.createDataFrame([(2, "tone", "client", "uses  short direct SENTENCES", "q", "r2", "low"), (3, "tone", "client", "Uses short direct phrases", "q", "r3", "low"), (4, "tone", "client", "Never jokes", "q", "r4", "low"), (5, "tone", "vendor", "Uses short direct sentences", "q", "r5", "low")], cols)
    got = {r["finding_no"]: r["status"] for r in qual.reconcile(new, prior).collect()}
    assert got == {2: "matched", 3: "borderline", 4: "new", 5: "new"}
    groups = qual.cross_register(qual.merge(new), new).collect()
    assert len(groups) == 1 and groups[0]["registers"] == "client,vendor" and groups[0]["findings"] == 3


def test_planned_words():
    assert qual.planned_words(5000, lambda n: n // 100) == 3280
    with pytest.raises(ValueError):
        qual.planned_words(5000, lambda n: 1000)


def test_attempts(spark):
    chunks = spark.createDataFrame([("a", 0, "pending"), ("b", 2, "pending"), ("c", 0, "pending")], "chunk_id string, attempts int, status string")
    results = spark.createDataFrame([("a", True), ("b", False)], "chunk_id string, valid boolean")
    assert {r["chunk_id"]: (r["attempts"], r["status"]) for r in qual.attempted(chunks, results).collect()} == {"a": (1, "done"), "b": (3, "failed"), "c": (0, "pending")}
    lines = qual.dispatched(spark.createDataFrame([("a", "x\ny")], "chunk_id string, text string"), str.splitlines)
    assert [r["value"] for r in lines.collect()] == ["x", "y"]


def test_guard(spark):
    def flag(f, text):
        return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]

    assert flag(guard.real_address, "a@b.com") and not flag(guard.real_address, "a@example.com b@x.example")
    assert flag(guard.private_address, "at 10.1.2.3 now") and not flag(guard.private_address, "8.8.8.8 10.1.2.300 v10.1.2.3.4")
    assert flag(guard.host_port, "db-1:5432") and flag(guard.host_port, "localhost:80") and not flag(guard.host_port, "01:30 node:22")
    assert flag(guard.artifact, "x/mail.pst") and flag(guard.artifact, "raw/x.jsonl") and not flag(guard.artifact, "tests/fixtures/mail.pst")
    names = guard.name_hits(spark.createDataFrame([(1, "So Will went. Will he? em dash ED ann"), (2, "Don't. Don's")], "id int, text string"), ["Will", "Ed", "Ann", "Don"], common=["will"])
    assert {(r["id"], r["name"]) for r in names.collect()} == {("1", "Will"), ("2", "Don")}


def test_lint(spark):
    drafts = spark.createDataFrame([(1, "Subject: Hi\n\nI hope this finds you well!! The colour is color — a game-changer.", "email", "client"), (2, "Fine.", "article", "client")], "draft_id long, text string, medium string, register string")
    rules = {r["rule_id"] for r in lint.bans(drafts).collect()}
    assert rules == {"rules.opening-hope", "rules.game-changer", "rules.double-bang"}
    spots = {(r["rule_id"], r["line"], r["col"], r["excerpt"]) for r in lint.locations(drafts, (lint.Ban("bang", "!", "char"), lint.Ban("well", "well"))).collect()}
    assert spots == {("rules.bang", 3, 27, "!"), ("rules.bang", 3, 28, "!"), ("rules.well", 3, 23, "")}
    assert {r["rule_id"] for r in lint.limits(drafts).collect()} == {"rules.exclamations_max", "rules.em_dashes_max"}
    assert [(r["observed"], r["expected"]) for r in lint.spelling(drafts).collect()] == [("color", "colour")]
    assert drafts.select(lint.without_subject(F.col("text")).alias("x")).first()["x"].startswith("I hope")
    with pytest.raises(ValueError, match="kind.*severity"):
        lint.validated([{"id": "a", "pattern": "x", "kind": "glob", "severity": "bad"}])


def test_limits_by_register_stand_for_bands(spark):
    table = {"email": {"exclamations_max": 0, "registers": {"client": {"exclamations_max": 2}}}}
    text = "Fine! Good! " + "We said so and we meant it all. " * 20
    rows = [(k, text, "email", r) for k, r in enumerate(["client", "vendor"])]
    drafts = spark.createDataFrame(rows, "draft_id long, text string, medium string, register string")
    assert [(r["draft_id"], r["expected"]) for r in lint.limits(drafts, table).collect()] == [(1, "0")]
    profile = spark.createDataFrame([(r, m, 0.0, 0.0, 40) for r in ("client", "vendor") for m in ("exclamations_per_email", "words")], "register string, metric string, band_p10 double, band_p90 double, n_gated long")
    values = lint.measured(drafts)
    assert {(r["draft_id"], r["rule_id"]) for r in lint.bands(values, profile).collect()} == {(k, f"stats.{m}") for k in (0, 1) for m in ("exclamations_per_email", "words")}
    assert {r["rule_id"] for r in lint.bands(values, profile, table=table).collect()} == {"stats.words"}
    # Where the sources differ, the current one's band holds.
    apart = spark.createDataFrame([("client", "words")], "register string, metric string")
    current = spark.createDataFrame([("client", "words", 0.0, 1e6, 40)], "register string, metric string, band_p10 double, band_p90 double, n_gated long")
    assert [(r["draft_id"], r["rule_id"]) for r in lint.bands(values, profile, table=table, diverging=apart, current=current).collect()] == [(1, "stats.words")]


def test_pages():
    assert extract.html_cut("<p>Hi &amp; bye</p><ul><li>one<li>two</ul><div class='gmail_quote'>old</div>") == ("Hi & bye\n- one\n- two", ["H3"], [])
    assert extract.html_cut("<style>x</style><b>Bold</b><br>next<hr><div id=divRplyFwdMsg>From: x</div>")[:2] == ("*Bold*\nnext", ["H1"])
    assert extract.html_cut("<p>a</p><blockquote>q</blockquote><p>b</p>") == ("a", ["H7"], ["inline_html_suspected"])
    assert extract.html_cut("<p>a</p><blockquote>q<blockquote>r</blockquote></blockquote> ") == ("a", ["H7"], [])
    box = "<p>a</p><div style='border-top: solid 1px'>{0}</div><blockquote type=cite>q</blockquote>"
    assert extract.html_cut(box.format("<b>From:</b> x"))[1] == ["H6"] and extract.html_cut(box.format("b")) == ("a\nb", ["H4"], [])


OWN = [
    ("Mine\n-----Original Message-----\nFrom: a\ntheirs", "Mine", ["T1"], [], False),
    ("Mine\n---- Forwarded message ----\nx", "Mine", ["T2"], [], False),
    ("Mine\n____________\nFrom: a\nSent: b\nx", "Mine", ["T3"], [], False),
    ("Mine\n____________\nx", "Mine\n____________\nx", [], [], False),
    ("Mine\nFrom: a\nSent: b\n\nTo: c\ntheirs", "Mine", ["T4"], [], False),
    ("Mine\nOn Monday, 1 May, Bob\nwrote:\n> old", "Mine", ["T5"], [], False),
    ("Mine\n> a\n\n> b", "Mine", ["T6"], [], False),
    ("Mine\n> a\nyours", "Mine\nyours", [], [], True),
    ("Top\nOn Monday last week, Bob wrote:\n> a\nanswer a\n> b\nanswer b", "Top\nanswer a\nanswer b", ["T5"], [], True),
    ("Hi\nSent from my iPhone", "Hi", ["mobile-footer"], [], False),
    ("See my comments below\n-----Original Message-----\nplain text", "See my comments below", ["T1"], ["inline_suspected"], False),
    ("cut here\nx", "cut here\nx", [], [], False),
    ("", "", [], [], False),
    (None, "", [], [], False),
]


def test_own_text(spark):
    df = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(OWN)], "id int, t string")
    got = {r["id"]: r["x"] for r in df.select("id", extract.own_text("t").alias("x")).collect()}
    for k, (_, *want) in enumerate(OWN):
        assert list(got[k]) == want, k
    assert df.where("id = 11").select(extract.own_text("t", ("^CUT HERE$",)).alias("x")).first()["x"]["rules"] == ["T7"]


def test_scrub(spark):
    text = "I met Anna. Will is here; Will pay $1,234,567. Mail a.b@x.org or see www.x.org/y, call +1 212 555 0100, id 1234567."
    df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    got = {r["id"]: r for r in extract.scrubbed(df, ["Anna", "Will"], common=["will", "mail"]).collect()}
    assert got[1]["text"] == "I met [NAME]. Will is here; [NAME] pay $1,234,567. Mail [EMAIL] or see [URL], call [PHONE], id [NUM]."
    assert tuple(got[1][c] for c in ("lexicon_names", "emails", "urls", "phones", "numbers")) == (2, 1, 1, 1, 1)
    assert got[1]["residual"] == ["Will"]
    assert got[2]["text"] == "" and got[2]["residual"] == []


def test_signatures(spark):
    def strip(text, owners, learned):
        df = spark.createDataFrame([(text, learned)], "t string, l array<string>")
        return tuple(df.select(extract.signature(F.col("t"), F.col("l"), owners).alias("x")).first()["x"])

    learned = ["Head of x", "Call 1"]
    assert strip("Body\nRegards,\nOwner\nHead of x\nCall 1", ("Owner",), learned) == ("Body\nRegards,\nOwner", "regards", ["signature-fingerprint"])
    assert strip("Body\n-- \nx", (), None) == ("Body", None, ["sig-dash"])
    legal = "This mail is confidential " + "and so on " * 12
    assert strip(f"Body\nRegards\nOwner\nMore\n\n{legal}\n\nend", ("Owner",), []) == ("Body\nRegards\nOwner", "regards", ["legal-disclaimer"])
    assert strip("", (), []) == ("", None, [])
    rows = [(f"r{k}", "s", 2020, f"Text {k}\nRegards\nOwner\nHead of x\nCall 555 0100 200") for k in range(12)]
    got = extract.learned_signatures(spark.createDataFrame(rows, "record_id string, source string, year int, text string"), ["Owner"]).collect()
    assert {r["line"] for r in got} == {"Head of x", "Call 555 0100 200"}


def test_recipients_between_semicolons():
    assert mail.addresses(['A <a@example.org>; "B; C" <b@example.net>; c@example.com']) == [("A", "a@example.org"), ("B; C", "b@example.net"), ("", "c@example.com")]
    assert mail.addresses(["", ";"]) == []


@pytest.mark.parametrize("ban", lint.HABITS, ids=lambda h: h[0])
def test_each_habit_has_a_hit(ban):
    i, kind, pattern, example = ban
    assert i.startswith("ai-") and (re.search("(?im)" + pattern, example) if kind == "regex" else pattern.lower() in example.lower())
    assert len(lint.HABIT_BANS) == 40 == len({b.id for b in lint.HABIT_BANS})


def test_source_selection_and_refusals(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "source string, n int")
    assert [r["n"] for r in rec.selected(rows, ["a", "b"], ["b"]).collect()] == [2] and rec.selected(rows, ["a", "b"], []).count() == 2
    with pytest.raises(ValueError, match="no such source: c"):
        rec.selected(rows, ["a", "b"], ["a", "c"])
    reports = spark.createDataFrame([("a", "done", "2024-03-09"), ("b", "partial", "2024-03-09"), ("c", "done", "2024-03-01"), ("d", "done", None)], "source string, status string, dumped string").withColumn("dumped", F.col("dumped").cast("date"))
    now = F.lit("2024-03-10").cast("date")
    with pytest.raises(ValueError, match="b: partial; c: stale; d: stale"):
        rec.checked(reports, now)
    rec.checked(reports.where("source = 'a'"), now)


def test_token_budget(spark):
    picks = spark.createDataFrame([(r, k, 100) for r in ("x", "y") for k in range(5)], "register string, pick_rank int, word_count long")
    assert select.within_budget(picks, 1800).count() == 10
    assert select.within_budget(picks, 1000, minimum=2).count() == 4
    with pytest.raises(ValueError, match="budget by 20"):
        select.within_budget(picks, 700, minimum=2)


EML = b"""From: Me <me@example.com>
To: A <a@example.org>, b@example.net
Message-ID: <1@x>
Subject: =?utf-8?q?H=C3=A9?=
Date: Mon, 01 Jan 2024 10:00:00 +0000
Content-Type: text/plain; charset=utf-8

Hello there.
"""


def test_mail_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.eml").write_bytes(EML)
    (tmp_path / "in/all.mbox").write_bytes(b"From x Mon\n" + EML + b"\n>From here\n\nFrom y Tue\n" + EML.replace(b"<1@x>", b"<2@x>"))
    r = mail.read_eml(spark, str(tmp_path / "in")).collect()
    assert len(r) == 1 and r[0]["subject"] == "Hé" and [x["address"] for x in r[0]["recipients"]] == ["a@example.org", "b@example.net"]
    box = mail.read_mbox(spark, str(tmp_path / "in")).orderBy("locator").collect()
    assert [b["message_id"] for b in box] == ["<1@x>", "<2@x>"] and "\nFrom here" in box[0]["plain"]
    sent = mail.owner_sent(mail.read_mbox(spark, str(tmp_path / "in")), ["ME@example.com"])
    assert sent.count() == 2
    item = tmp_path / "tree/Sent/Message00001"
    item.mkdir(parents=True)
    (item / "OutlookHeaders.txt").write_text("Subject: Hi\nClient submit time: Jan 1\n")
    (item / "Recipients.txt").write_text("Display name: A\nEmail address: a@x.org\nRecipient type: To\n\nDisplay name: B\nEmail address: b@x.org\nRecipient type: CC\n")
    (item / "Message.txt").write_text("Body")
    tree = mail.read_export(spark, str(tmp_path / "tree"))
    got = tree.first()
    assert got["plain"] == "Body" and [(x["address"], x["kind"]) for x in got["recipients"]] == [("a@x.org", "to"), ("b@x.org", "cc")]
    assert tree.where(mail.in_folders(F.col("locator"))).count() == 1
    for k in (1, 2):
        (tmp_path / f"v{k}.md").write_text(f"---\ntitle: T\ndate: 2024-01-0{k}\n---\nv{k}")
    assert [(r["version"], r["text"][-2:]) for r in mail.markdown_chains(spark, str(tmp_path)).orderBy("version").collect()] == [(0, "v1"), (1, "v2")]
    (tmp_path / "terms.txt").write_text("# c\nOne\n\none\nTwo\n")
    assert {r["term"] for r in mail.read_lexicon(spark, str(tmp_path / "terms.txt")).collect()} == {"one", "two"}


def test_ingest_takes_new_files_once(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    into, out, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    docs.where("doc_id < 50").write.mode("append").parquet(into)
    ingest.ingest_documents(spark, into, out, at)
    docs.where("doc_id >= 50").write.mode("append").parquet(into)
    ingest.ingest_documents(spark, into, out, at)
    ingest.ingest_documents(spark, into, out, at)
    assert spark.read.parquet(out).count() == docs.count()


def test_config():
    good = {"owner": {"names": ["A"]}, "source": [{"label": "old", "kind": "mbox"}, {"label": "new", "kind": "eml", "llm_eligible": True, "llm": {"provider": "p", "purpose": "q", "confirmed_by": "r", "date": "2024-01-01"}}]}
    c = config.validate(good)
    assert c.current_source == "new" and c.eligible == {"new"}
    with pytest.raises(ValueError, match="owner.names.*source"):
        config.validate({})
    bad = {**good, "domain_map": {"domains": {"x.org": "friend"}}}
    with pytest.raises(ValueError, match="unknown classes"):
        config.validate(bad)


def test_every_query_has_rows_and_sql_names(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 80
