"""The URL models held against plain Python: every gram, every row, the query string too."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from prosestat.llm import url_filter


def brute(rows, folds):
    """{page_id: (score, verdict)} of (page_id, url, label), urls in lower case with a scheme,
    each scored by the models of the other folds."""
    order, tables = url_filter.ORDER, {}
    lines = [(i, u.split("://")[1].split("#")[0], folds[u.split("://")[1].split("#")[0]], label) for i, u, label in rows]
    cut = lambda line: [("\x02" * order + line)[j : j + order + 1] for j in range(len(line))]
    for fold in set(folds.values()):
        for label in ("allow", "block"):
            counts = [Counter() for _ in range(order + 1)]
            for _, line, f, of in lines:
                for g in cut(line) if of == label and f != fold else ():
                    for k in range(order + 1):
                        counts[k][g[order - k :]] += 1
            total, kinds = defaultdict(int), defaultdict(int)
            for k in range(order + 1):
                for g, n in counts[k].items():
                    total[k, g[:-1]] += n
                    kinds[k, g[:-1]] += 1
            tables[fold, label] = counts, total, kinds

    def chance(fold, label, g):
        counts, total, kinds = tables[fold, label]
        p = 1 / 256
        for k in range(order + 1):
            s = g[order - k :]
            d = max(kinds[k, s[:-1]], 1)
            p = (counts[k][s] + d * p) / (total[k, s[:-1]] + d)
        return p

    known = {}

    def ratio(fold, g):
        if (fold, g) not in known:
            known[fold, g] = math.log(chance(fold, "allow", g) / chance(fold, "block", g))
        return known[fold, g]

    score = {(line, f): sum(ratio(f, g) for g in cut(line)) / len(line) for line, f in {(x, f) for _, x, f, _ in lines}}
    at = {label: sorted(round(score[x, f] * 1000) for _, x, f, of in lines if of == label) for label in ("allow", "block")}
    least = next(v for k, v in enumerate(at["allow"], 1) if k > (1 - url_filter.ACCEPTED) * len(at["allow"])) / 1000
    return {i: (score[x, f], "allow" if score[x, f] >= least else "block") for i, x, f, _ in lines}, least, len(known)


def folds_of(spark, rows):
    from pyspark.sql import functions as F

    lines = spark.createDataFrame([(x,) for x in sorted({u.split("://")[1].split("#")[0] for _, u, _ in rows})], "line string")
    return {r["line"]: r["f"] for r in lines.select("line", F.pmod(F.xxhash64("line"), F.lit(url_filter.FOLDS)).alias("f")).collect()}


@pytest.mark.parametrize("n", [40, 4000])
def test_models_keep_every_gram_and_count_every_row(spark, n):
    rng = random.Random(7)
    word = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=k))
    rows = []
    for k in range(n):
        host = f"{word(6)}.casino.biz" if k % 3 == 0 else f"{word(8)}.edu"
        for _ in range(25 if k % 20 == 0 else 1):  # some URLs stand in many rows
            rows.append((len(rows), f"http://{host}/{word(8)}?q={word(4)}#{word(3)}", "block" if k % 3 == 0 else "allow"))
    hot = [(len(rows) + j, "http://hot.edu/same?page=1", "allow") for j in range(50)]
    rows += hot
    want, least, grams = brute(rows, folds_of(spark, rows))
    assert n < 4000 or grams > 60_000
    table = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(table, ()).collect()}
    assert len(got) == len(rows)
    for i, (score, verdict) in want.items():
        assert got[i]["score"] == pytest.approx(score, abs=2e-8)
        assert abs(score - least) < 1e-7 or got[i]["verdict"] == verdict


def test_hosts_of_words_that_were_not_listed(spark):
    """Words that only resemble listed ones are no listed words; the models block their hosts all
    the same, and allow hosts of neither kind."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["re", "ta", "lin", "mo", "sha", "ver", "dun", "kel", "o", "s"]) for _ in range(rng.randint(2, 4)))
    listed = ["casino", "poker", "betting"]
    given = [f"http://{word()}-{rng.choice(listed)}.biz/{word()}" for _ in range(500)] + [f"http://{word()}{rng.choice('.-')}{word()}.biz/{word()}" for _ in range(1500)]
    new = [f"http://{word()}-{w}{end}.biz/{word()}" for w in listed for end in ("s", "ia", "y")]
    clean = [f"http://{word()}-{word()}.biz/{word()}" for _ in range(60)]
    assert not any(set(re.split("[^a-z]+", u.split("/")[2])) & set(listed) for u in new + clean)
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(list(enumerate(given + new + clean)), "page_id long, url string"), (), tuple(listed)).collect()}
    at = len(given)
    assert sum(got[at + k] == "block" for k in range(len(new))) > 0.5 * len(new)
    assert sum(got[at + len(new) + k] == "allow" for k in range(len(clean))) >= 0.95 * len(clean)
