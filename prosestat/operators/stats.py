"""Distributions, thresholds, frequency tables, n-grams and contrasts by register.

Statistics are long tables with one row for each register and metric. Values are counted by
register and metric, combined before the shuffle; the roll-up ``_global`` adds up those counts,
and exact percentiles come from running sums over them, so no task holds a group's values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text as tx

#: Added before rounding, so that ties fall alike however a sum was ordered.
EPS = 1e-9
ALL = "_global"
THIN = 30
POINTS = [0.1, 0.25, 0.5, 0.75, 0.9]


def per_record(rows: DataFrame) -> DataFrame:
    """rows with greeting, signoff, body, METRICS and gated; compute once and keep."""
    return tx.measured(tx.prepared(rows))


def long_form(values: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """One row for each record and metric."""
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names))
    return values.select(*keep, F.inline(pairs))


def _rolled(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Every row for its register and once more for the roll-up."""
    return rows.withColumn("register", F.explode(F.array(F.col("recipient_class"), F.lit(ALL)))).groupBy("register", *by)


def counts_of(values: DataFrame, names: list[str], weights: dict[str, Column], *by: str) -> DataFrame:
    """(by..., metric, value, weights...): in how many rows each value occurs for which a weight
    holds; nulls are left out of the weights. The only step that reads the measured rows: what is
    built on it must use all weights, so that the plan holds it once."""
    rows = long_form(values.select(*by, *(w.alias(c) for c, w in weights.items()), *names), names, *by, *weights).withColumn("value", F.round("value", 9))
    return rows.groupBy(*by, "metric", "value").agg(*(F.count_if(F.col(c) & F.col("value").isNotNull()).alias(c) for c in weights))


def _spread(counts: DataFrame, groups: Column, *keys: str) -> DataFrame:
    """counts for each of the groups (an array of structs) that a row belongs to, summed."""
    weights = [c for c in ("n", "g") if c in counts.columns]
    return counts.select("metric", "value", *weights, F.inline(groups)).groupBy(*keys, "metric", "value").agg(*(F.sum(c).alias(c) for c in weights))


def counted(values: DataFrame, names: list[str], *by: str) -> DataFrame:
    """(register, by..., whole, metric, value, n, g): how often each value occurs, and how often
    in gated rows, for each register and the roll-up; ``whole``: and for all rows together, where
    there are other keys. Nulls are left out of n and g."""
    per = counts_of(values, names, {"n": F.lit(True), "g": F.col("gated")}, "recipient_class", *by)
    at = lambda register, whole: F.struct(register.alias("register"), *((F.lit(None).cast(per.schema[c].dataType) if whole else F.col(c)).alias(c) for c in by), F.lit(whole).alias("whole"))
    groups = [at(F.col("recipient_class"), False), at(F.lit(ALL), False), *([at(F.lit(ALL), True)] if by else [])]
    return _spread(per, F.array(*groups), "register", *by, "whole")


def quantiles(counts: DataFrame, keys: list[str], wanted: dict[str, list[float]]) -> DataFrame:
    """(keys..., for each weight column its total ``<column>_n`` and its exact interpolated
    quantiles as an array ``<column>_q``, null without values), from counted values whose weights
    are 0 for nulls.

    The running sums and the totals are both taken of counts as they are, without a filter, so
    that they share one exchange."""
    totals = counts.groupBy(*keys).agg(*(F.sum(c).alias(f"{c}_n") for c in wanted), *(F.sum(F.col("value") * F.col(c)).alias(f"{c}_sum") for c in wanted), *(F.sum(F.when(F.col("value") != 0, F.col(c)).otherwise(0)).alias(f"{c}_some") for c in wanted))
    w = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumns({f"{c}_to": F.sum(c).over(w) for c in wanted})
    # One row for each register and metric.
    named = totals.select(*(F.col(k).alias(f"_{k}") for k in keys), *(f"{c}_n" for c in wanted))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    ranked = ranked.join(F.broadcast(named), same).drop(*(f"_{k}" for k in keys))

    def at(c: str, rank: Column) -> Column:
        """The value at a rank from 0."""
        return F.max(F.when((F.col(f"{c}_to") > rank) & (F.col(f"{c}_to") - F.col(c) <= rank), F.col("value")))

    ends = []
    for c, points in wanted.items():
        for k, p in enumerate(points):
            place = (F.col(f"{c}_n") - 1) * F.lit(p)
            ends += [at(c, F.floor(place)).alias(f"{c}_{k}_lo"), at(c, F.ceil(place)).alias(f"{c}_{k}_hi"), F.max(place - F.floor(place)).alias(f"{c}_{k}_part")]
    found = ranked.groupBy(*keys).agg(*ends)
    arrays = [F.when(F.col(f"{c}_n") > 0, F.array(*(F.col(f"{c}_{k}_lo") + (F.col(f"{c}_{k}_hi") - F.col(f"{c}_{k}_lo")) * F.col(f"{c}_{k}_part") for k in range(len(points))))).alias(f"{c}_q") for c, points in wanted.items()]
    found = found.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in found.columns if c not in keys))
    return totals.join(found, same, "left").select(*keys, *(f"{c}_{x}" for c in wanted for x in ("n", "sum", "some")), *arrays)


def distribution(values: DataFrame, *by: str, minimum: int = THIN) -> DataFrame:
    """(register, by..., metric): n, mean, nonzero_share, p10..p90 and the lint band of gated
    rows, or the overall gated band where the register has too few."""
    spread = quantiles(counted(values, tx.METRICS, *by), ["register", *by, "whole", "metric"], {"n": POINTS, "g": [0.1, 0.25, 0.75, 0.9]})
    # A window over one row for each register and metric, as a join would measure all texts again.
    whole = F.col("whole") if by else F.col("register") == ALL
    w = Window.partitionBy("metric")
    spread = spread.withColumns({"gb": F.max(F.when(whole, F.col("g_q"))).over(w), "gn": F.max(F.when(whole, F.col("g_n"))).over(w)}).where("not whole")
    thin = F.col("g_n") < minimum
    band = F.when(thin, F.col("gb")).otherwise(F.col("g_q"))
    at = lambda a, i: F.round(F.coalesce(F.get(a, F.lit(i)), F.lit(0.0)) + EPS, 4)
    return spread.select(
        "register",
        *by,
        "metric",
        F.col("n_n").alias("n"),
        F.round(F.col("n_sum") / F.col("n_n") + EPS, 4).alias("mean"),
        F.round(F.col("n_some") / F.col("n_n") + EPS, 4).alias("nonzero_share"),
        *(at(F.col("n_q"), i).alias(f"p{round(100 * p)}") for i, p in enumerate(POINTS)),
        *(at(band, i).alias(f"band_p{p}") for i, p in enumerate((10, 25, 75, 90))),
        F.when(thin, F.col("gn")).otherwise(F.col("g_n")).alias("n_gated"),
        thin.alias("fallback_global"),
    )


def tell_thresholds(values: DataFrame, minimum: int = THIN) -> DataFrame:
    """(register, metric): direction, threshold, p50, n, basis. A register without enough values
    takes the roll-up's threshold."""
    values = values if "gated" in values.columns else values.withColumn("gated", F.lit(False))
    per = quantiles(counted(values, list(tx.TELLS)), ["register", "metric"], {"n": [0.1, 0.5, 0.9]}).withColumnsRenamed({"n_n": "n", "n_q": "q"})
    up = F.col("metric").isin([m for m, d in tx.TELLS.items() if d == "max"])
    floor = F.when(F.col("metric") == "service_phrases", 1.0).otherwise(0.0)
    per = per.withColumn("own", F.when(F.col("n") >= minimum, F.when(up, F.greatest(F.get("q", F.lit(2)), floor)).otherwise(F.get("q", F.lit(0)))))
    per = per.withColumn("all", F.max(F.when(F.col("register") == ALL, F.col("own"))).over(Window.partitionBy("metric")))
    back = F.col("own").isNull() & F.col("all").isNotNull()
    return per.select("register", "metric", F.when(up, "max").otherwise("min").alias("direction"), F.round(F.coalesce("own", "all") + EPS, 4).alias("threshold"), F.round(F.coalesce(F.get("q", F.lit(1)), F.lit(0.0)) + EPS, 4).alias("p50"), "n", F.when(back & (F.col("register") != ALL), ALL).otherwise("register").alias("basis"))


def tertile_cut(rows: DataFrame) -> DataFrame:
    """One row: the upper inclusive tertile of word_count."""
    counts = rows.groupBy(F.col("word_count").cast("double").alias("value")).agg(F.count("word_count").alias("n")).withColumn("all", F.lit(ALL))
    return quantiles(counts, ["all"], {"n": [2 / 3]}).select(F.get("n_q", F.lit(0)).alias("cut"))


def long_texts(rows: DataFrame) -> DataFrame:
    """Rows above the upper tertile of length."""
    return rows.join(F.broadcast(tertile_cut(rows)), F.col("word_count") > F.col("cut")).drop("cut")


def anchor_article(rows: DataFrame, article: Column, minimum: int = THIN) -> DataFrame:
    """The bands of the rows that are articles, those of few rows replaced by the long texts'.
    Both are counted in one pass over the measured rows."""
    values = rows.crossJoin(F.broadcast(tertile_cut(rows))).withColumn("_long", F.col("word_count") > F.col("cut")).withColumn("_own", article)  # one row
    counts = counts_of(values, tx.METRICS, {"o": F.col("_own"), "l": F.col("_long"), "og": F.col("_own") & F.col("gated"), "lg": F.col("_long") & F.col("gated")})
    points = [0.1, 0.25, 0.75, 0.9]
    both = quantiles(counts, ["metric"], {"o": [0.5], "l": [0.5], "og": points, "lg": points}).where("o_q is not null and l_q is not null")
    thin = F.col("og_n") < minimum
    at = lambda i: F.round(F.coalesce(F.get(F.when(thin, F.col("lg_q")).otherwise(F.col("og_q")), F.lit(i)), F.lit(0.0)) + EPS, 4)
    return both.select(F.lit("article").alias("register"), "metric", *(at(i).alias(f"band_p{p}") for i, p in enumerate((10, 25, 75, 90))), F.when(thin, F.col("lg_n")).otherwise(F.col("og_n")).alias("n_gated"), F.when(thin, "long_emails").otherwise("register").alias("basis"))


# --- frequencies ---------------------------------------------------------------------------


def tokens(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(tx.words(F.coalesce("text", F.lit("")))).alias("token"))


def token_counts(rows: DataFrame) -> DataFrame:
    """(register, token, n), tokens in lower case; counted in each task before the shuffle."""
    return _rolled(tokens(rows, "recipient_class").withColumn("token", F.lower("token")), ("token",)).agg(F.count("*").alias("n"))


def totals(rows: DataFrame) -> DataFrame:
    return _rolled(rows.select("recipient_class", tx.n_words(F.coalesce("text", F.lit(""))).alias("k")), ()).agg(F.sum("k").cast("long").alias("total"))


def _registers(spark) -> DataFrame:
    return spark.createDataFrame([(r,) for r in (*lex.CLASSES, ALL)], "register string")


def _terms(spark, terms: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in terms], f"{name} string")


def function_word_rates(rows: DataFrame) -> DataFrame:
    """(register, word, rate) per 1000 tokens, zeros kept."""
    spark = rows.sparkSession
    grid = _registers(spark).crossJoin(_terms(spark, lex.FUNCTION_WORDS, "word"))  # nine registers times a fixed list
    n = token_counts(rows).where(F.col("token").isin(lex.FUNCTION_WORDS)).select("register", F.col("token").alias("word"), "n")
    return grid.join(n, ["register", "word"], "left").join(totals(rows), "register", "left").select("register", "word", F.round(tx.rate(F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0)), 1000), 4).alias("rate"))


def phrase_hits(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(register, term, hits, total, rate): counts of phrases, zeros kept. One pass over the
    texts: each row yields one number for each term, summed by register."""
    counts = tx.phrase_counts(F.coalesce("text", F.lit("")), terms)
    per = _rolled(rows.select("recipient_class", counts.alias("c"), tx.n_words(F.coalesce("text", F.lit(""))).alias("k")), ()).agg(F.sum("k").cast("long").alias("total"), *(F.sum(F.get("c", F.lit(i))).cast("long").alias(f"c{i}") for i in range(len(terms))))
    full = _registers(rows.sparkSession).join(per, "register", "left")
    hits = F.inline(F.array(*(F.struct(F.lit(t).alias("term"), F.coalesce(f"c{i}", F.lit(0)).alias("hits")) for i, t in enumerate(terms))))
    return full.select("register", F.coalesce("total", F.lit(0)).alias("total"), hits).withColumn("rate", F.round(tx.rate(F.col("hits"), F.col("total"), 1000), 4))


def forms(rows: DataFrame, column: str) -> DataFrame:
    """(register, form, n, share) of greetings or sign-offs; shares are of all safe rows."""
    n = _rolled(rows, ()).agg(F.count("*").alias("all"))
    return _rolled(rows.where(F.col(column).isNotNull()), (column,)).agg(F.count("*").alias("n")).join(F.broadcast(n), "register").select("register", F.col(column).alias("form"), "n", F.round(F.col("n") / F.col("all"), 4).alias("share"))


def spelling(rows: DataFrame) -> DataFrame:
    """(register, grp, n): uses of each spelling of the variant pairs."""
    spark = rows.sparkSession
    kinds = [(g, b) for g, b, _ in lex.VARIANTS] + [({"ise": "ize", "our": "or"}[g], a) for g, _, a in lex.VARIANTS]
    table = spark.createDataFrame(kinds, "grp string, token string")
    grid = _registers(spark).crossJoin(table.select("grp").distinct())  # nine registers times four spellings
    n = token_counts(rows).join(F.broadcast(table), "token").groupBy("register", "grp").agg(F.sum("n").alias("n"))
    return grid.join(n, ["register", "grp"], "left").select("register", "grp", F.coalesce("n", F.lit(0)).alias("n"))


def dashes(rows: DataFrame) -> DataFrame:
    """(register, em, en): dashes per 1000 tokens."""
    count = lambda c: F.regexp_count(F.coalesce("text", F.lit("")), F.lit(c))
    per = _rolled(rows.select("recipient_class", count("—").alias("em"), count("–").alias("en"), tx.n_words(F.coalesce("text", F.lit(""))).alias("k")), ()).agg(*(F.sum(c).alias(c) for c in ("em", "en", "k")))
    return per.select("register", *(F.round(tx.rate(F.col(c), F.col("k"), 1000), 4).alias(c) for c in ("em", "en")))


# --- n-grams -------------------------------------------------------------------------------


def ngrams(rows: DataFrame, size: int, known: list[str] | None = None) -> DataFrame:
    """(recipient_class, phrase, n): windows without unknown capitalised words and not made of
    function words and masks alone."""
    known = sorted(set(known if known is not None else lex.common_words()))
    rows = rows.select("recipient_class", tx.words(F.coalesce("text", F.lit(""))).alias("_t")).withColumn("_w", F.transform("_t", F.lower))
    # Each word is looked at once, not once for each window: 1 is an unknown capitalised word, 2
    # a function word or mask.
    kind = lambda t, w: F.when(F.rlike(t, F.lit("^[A-Z]")) & ~w.isin(known), 1).when(w.isin(lex.FUNCTION_WORDS) | F.startswith(t, F.lit("[")), 2).otherwise(0)
    rows = rows.withColumn("_k", F.zip_with("_t", "_w", kind))
    starts = F.when(F.size("_w") >= size, F.sequence(F.lit(0), F.size("_w") - size)).otherwise(F.expr("cast(array() as array<int>)"))
    at = lambda c, i: [F.get(c, i + k) for k in range(size)]
    good = F.filter(starts, lambda i: reduce(lambda x, y: x & y, (k != 1 for k in at("_k", i))) & reduce(lambda x, y: x | y, (k != 2 for k in at("_k", i))))
    kept = rows.select("recipient_class", F.explode(F.transform(good, lambda i: F.concat_ws(" ", *at("_w", i)))).alias("phrase"))
    return kept.groupBy("recipient_class", "phrase").agg(F.count("*").alias("n"))


def keyness(a: Column, total_a: Column, b: Column, total_b: Column) -> Column:
    """Log-likelihood G2 of a 2 x 2 table; 0 where either side is empty."""
    whole, both = total_a + total_b, a + b
    term = lambda o, e: F.when((o > 0) & (e > 0), o * F.ln(o / e)).otherwise(F.lit(0.0))
    g = term(a, both * total_a / whole) + term(total_a - a, (whole - both) * total_a / whole) + term(b, both * total_b / whole) + term(total_b - b, (whole - both) * total_b / whole)
    return F.when((total_a > 0) & (total_b > 0), 2 * g).otherwise(F.lit(0.0))


def ranked_ngrams(rows: DataFrame, size: int, least: int = 5, top: int = 40, known: list[str] | None = None) -> DataFrame:
    """(register, phrase, n, keyness, rank): each register's phrases against all others'. The
    other registers' counts are the roll-up's less its own, so no second pass is needed."""
    per = ngrams(rows, size, known)
    whole = per.groupBy("phrase").agg(F.sum("n").alias("all"))
    sums = per.groupBy("recipient_class").agg(F.sum("n").alias("total"))
    grand = sums.agg(F.sum("total").alias("grand"))
    own = per.where(F.col("n") >= least).join(whole, "phrase").join(F.broadcast(sums), "recipient_class").join(F.broadcast(grand))
    d = lambda c: F.col(c).cast("double")
    scored = own.select(F.col("recipient_class").alias("register"), "phrase", "n", keyness(d("n"), d("total"), d("all") - d("n"), d("grand") - d("total")).alias("keyness"))
    scored = scored.unionByName(whole.where(F.col("all") >= least).select(F.lit(ALL).alias("register"), "phrase", F.col("all").alias("n"), F.lit(0.0).alias("keyness")))
    w = Window.partitionBy("register").orderBy(F.round("keyness", 6).desc(), F.col("n").desc(), "phrase")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).withColumn("keyness", F.round("keyness", 4))


# --- contrasts and projections --------------------------------------------------------------


def contrast(values: DataFrame, usable: Column, current: str, minimum: int = THIN) -> DataFrame:
    """(register, metric, source): whether a source's median, over all its rows, lies further from
    the current source's than the interquartile range of the usable rows of all sources. Both are
    counted in one pass over the measured rows."""
    per = counts_of(values.withColumn("_usable", usable), tx.METRICS, {"n": F.lit(True), "u": F.col("_usable")}, "recipient_class", "source")
    at = lambda register, merged: F.struct(register.alias("register"), (F.lit(None).cast("string") if merged else F.col("source")).alias("source"), F.lit(merged).alias("merged"), F.col("u" if merged else "n").alias("n"))
    groups = F.array(*(at(r, m) for r in (F.col("recipient_class"), F.lit(ALL)) for m in (False, True)))
    keys = ["register", "source", "merged", "metric"]
    counts = per.select("metric", "value", F.inline(groups)).groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    point = lambda i: F.round(F.coalesce(F.get("n_q", F.lit(i)), F.lit(0.0)) + EPS, 4)
    spread = quantiles(counts, keys, {"n": [0.25, 0.5, 0.75]}).select("register", "metric", "source", "merged", F.col("n_n").alias("n"), point(1).alias("p50"), F.round(point(2) - point(0), 4).alias("_iqr"))
    w = Window.partitionBy("register", "metric")
    of = lambda c, ok: F.max(F.when(ok, F.col(c))).over(w)
    held, now = F.col("merged") & (F.col("n") > 0), ~F.col("merged") & (F.col("source") == current)
    spread = spread.withColumns({"iqr": of("_iqr", held), "p50_current": of("p50", now), "n_current": of("n", now)})
    apart = F.abs(F.round(F.col("p50_current") - F.col("p50"), 4)) > F.col("iqr")
    status = F.when(F.least("n", "n_current") < minimum, "insufficient_data").when(apart, "diverging").otherwise("same")
    others = spread.where(~F.col("merged") & (F.col("source") != current) & F.col("p50_current").isNotNull() & F.col("iqr").isNotNull())
    return others.select("register", "metric", "source", "p50", "p50_current", "iqr", status.alias("status"))


def projected_function_words(rates: DataFrame, top: int = 10) -> DataFrame:
    """Each register's words whose rate differs most from the roll-up's, by log ratio; words
    the register lacks come first, words the roll-up lacks last."""
    whole = rates.where(F.col("register") == ALL).select("word", F.col("rate").alias("all"))
    gap = F.when((F.col("rate") > 0) & (F.col("all") > 0), F.round(F.abs(F.ln(F.col("rate") / F.col("all"))), 6)).when(F.col("all") > 0, F.lit(1e9)).otherwise(F.lit(0.0))
    own = rates.where(F.col("register") != ALL).join(F.broadcast(whole), "word").withColumn("gap", gap)
    w = Window.partitionBy("register").orderBy(F.col("gap").desc(), "word")
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("register", "word", "rate", "rank")


def projected_metrics(spread: DataFrame) -> DataFrame:
    return spread.select("register", "metric", "n", "p25", "p50", "p75")


def histogram(rows: DataFrame, *columns: str) -> DataFrame:
    """(field, value, n) of each column, nulls left out."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(F.inline(pairs)).where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))


def corpus_summary(rows: DataFrame) -> DataFrame:
    """(source): records, low ones, words, first and last year."""
    return rows.groupBy("source").agg(F.count("*").alias("records"), F.count_if(F.col("confidence") == "low").alias("low"), F.sum("word_count").alias("words"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
