"""Queries by name, and their SQL.

Names begin with the operator they show. Texts come from ``documents`` and the literal
fixtures; drafts and chains from ``conversations``; recipients, pages and dates from the tables
that hold their like.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import text as tx
from ..operators import delta, extract, guard, lint, qual, records as rec, select, stats
from . import fixtures, sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rows(spark: SparkSession, sf: str, measure=None) -> DataFrame:
    docs = table(spark, sf, "documents").unionByName(fixtures.frame(spark))
    return rec.records(docs, table(spark, sf, "labels"), measure)


def templated(spark: SparkSession, sf: str, measure=None) -> DataFrame:
    return rec.templates(rows(spark, sf, measure))


def usable(spark: SparkSession, sf: str, measure=None) -> DataFrame:
    return rec.usable(templated(spark, sf, measure))


def _told(df: DataFrame) -> DataFrame:
    return tx.told(tx.prepared(df))


def measured(spark: SparkSession, sf: str) -> DataFrame:
    return usable(spark, sf, stats.per_record)


def told(spark: SparkSession, sf: str) -> DataFrame:
    return usable(spark, sf, _told)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + stats.EPS, 4) for n in names})


R = sql.records()
M = f"{R}, {sql.prepared('usable')}, {sql.measured('prep')}"
ROLL = "(SELECT *, unnest([recipient_class, '_global']) AS register FROM {0})"


def select_sql(ctes: str, body: str) -> str:
    return f"{ctes} {body}"


# --- records, filters, deduplication ---------------------------------------------------------


@query(f"{R} SELECT record_id, source, eligible, recipient_class, thread_position, coalesce(year, 0) AS year, word_count, confidence, sensitive, template FROM tpl")
def d02_templates(spark, sf):
    return templated(spark, sf).select("record_id", "source", "eligible", "recipient_class", "thread_position", F.coalesce("year", F.lit(0)).alias("year"), "word_count", "confidence", "sensitive", "template")


@query(f"{R} SELECT record_id, recipient_class FROM usable")
def d04_usable(spark, sf):
    return usable(spark, sf).select("record_id", "recipient_class")


@query("SELECT * FROM (SELECT substr(sha256(user_id::VARCHAR), 1, 16) AS record_id, event_id, count(*) OVER (PARTITION BY user_id) AS seen, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def d01_first_wins(spark, sf):
    events = table(spark, sf, "events").withColumn("record_id", rec.record_id(F.col("user_id").cast("string")))
    return rec.unique(events, "ts", "event_id").select("record_id", "event_id", "seen", F.lit(1).cast("long").alias("k"))


@query(f"{R}, parts AS (SELECT *, doc_id % 2 AS rank FROM rec UNION ALL SELECT *, 2 AS rank FROM rec WHERE doc_id % 3 = 0), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY rank, doc_id) AS rn FROM parts) WHERE rn = 1), keyed AS (SELECT *, count(*) OVER (PARTITION BY lower(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))) >= 3 AS template FROM one) SELECT count(*)::BIGINT AS records, count(*) FILTER (template)::BIGINT AS templates, (SELECT count(*) FROM parts)::BIGINT AS seen, (SELECT count(*) FROM parts) - count(*) AS duplicates FROM keyed")
def d03_merge(spark, sf):
    r = rows(spark, sf)
    parts = [r.where("doc_id % 2 = 0"), r.where("doc_id % 2 = 1"), r.where("doc_id % 3 = 0")]
    merged = rec.merge(parts, "doc_id")
    seen = sum(F.col(c) for c in ("a", "b", "c"))
    sizes = r.agg(F.count_if(F.col("doc_id") % 2 == 0).alias("a"), F.count_if(F.col("doc_id") % 2 == 1).alias("b"), F.count_if(F.col("doc_id") % 3 == 0).alias("c"))
    out = merged.agg(F.count("*").alias("records"), F.count_if("template").alias("templates")).crossJoin(sizes)  # one row each
    return out.select("records", "templates", seen.alias("seen"), (seen - F.col("records")).alias("duplicates"))


@query(f"{R} SELECT (SELECT count(*) FROM tpl)::BIGINT AS seen, (SELECT count(*) FROM usable)::BIGINT AS kept, (SELECT count(*) FROM tpl WHERE record_id NOT IN (SELECT record_id FROM usable))::BIGINT AS rejected, true AS conserved")
def d05_conservation(spark, sf):
    seen, kept = templated(spark, sf), usable(spark, sf)
    return rec.conserved(seen, kept, seen.join(kept.select("record_id"), "record_id", "left_anti"))


@query(f"{R} SELECT count(*) FILTER (year < 2020)::BIGINT AS kept, count(*) FILTER (year >= 2020)::BIGINT AS later, count(*) FILTER (year IS NULL)::BIGINT AS undated, count(*) FILTER (year BETWEEN 2016 AND 2018)::BIGINT AS in_era FROM rec")
def f05_cutoff_and_era(spark, sf):
    r = rows(spark, sf)
    kept = rec.before(r, "2020-06-01").agg(F.count("*").alias("kept"))
    return kept.crossJoin(r.agg( F.count_if(F.col("year") >= 2020).alias("later"), F.count_if(F.col("year").isNull()).alias("undated"), F.count_if(F.col("year").between(2016, 2018)).alias("in_era")))  # one row each


@query(f"{R} SELECT record_id FROM usable WHERE eligible AND NOT sensitive AND NOT has_residual")
def f08_phrase_safe(spark, sf):
    return rec.phrase_safe(usable(spark, sf)).select("record_id")


@query(f"{R} SELECT record_id FROM tpl WHERE eligible AND confidence = 'high' AND NOT template AND NOT sensitive AND NOT inline_reply AND NOT has_residual AND word_count BETWEEN 8 AND 80")
def f09_exemplar_eligible(spark, sf):
    return templated(spark, sf).where(rec.exemplar_eligible()).select("record_id")


@query(f"{R} SELECT record_id FROM tpl WHERE eligible AND confidence = 'high' AND NOT template AND NOT sensitive AND word_count <= 2000")
def f10_sample_eligible(spark, sf):
    return templated(spark, sf).where("eligible and confidence = 'high' and not template and not sensitive and word_count <= 2000").select("record_id")


@query("SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND NOT (role = 'assistant' AND turn > 5)")
def f01_label_and_owner(spark, sf):
    """Rows of an owner's role whose labels hold no excluded one."""
    c = table(spark, sf, "conversations").withColumn("labels", F.when((F.col("role") == "assistant") & (F.col("turn") > 5), F.array(F.lit("Drafts"))).otherwise(F.array(F.lit("Sent"))))
    return c.where(F.col("role").isin("user", "assistant") & ~F.arrays_overlap("labels", F.lit(lex.EXCLUDED_LABELS))).select("conv_id", "turn")


@query(f"{R} SELECT record_id, source FROM rec WHERE source IN ('src0', 'src2')")
def f11_selected_sources(spark, sf):
    return rec.selected(rows(spark, sf), [f"src{k}" for k in range(10)], ["src0", "src2"]).select("record_id", "source")


@query("SELECT source, reason FROM (SELECT n_name AS source, CASE WHEN n_nationkey % 5 = 0 THEN 'failed' WHEN n_nationkey % 5 = 1 THEN 'partial' WHEN n_nationkey % 7 = 2 OR n_nationkey % 10 > 7 THEN 'stale' END AS reason FROM nation) WHERE reason IS NOT NULL")
def f12_refused_sources(spark, sf):
    """Nations as sources; dumps are up to nine days old, some of no known date."""
    k = F.col("n_nationkey")
    now = F.lit("2024-03-10").cast("date")
    dumped = F.when(k % 7 != 2, F.date_sub(now, (k % 10).cast("int")))
    reports = table(spark, sf, "nation").select(F.col("n_name").alias("source"), F.get(F.lit(["failed", "partial", "done", "done", "done"]), (k % 5).cast("int")).alias("status"), dumped.alias("dumped"))
    return rec.refusals(reports, now)


# --- classification ---------------------------------------------------------------------------


def _recipients(spark, sf):
    """Customers as recipients of their nation's messages."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    address = F.when(k % 5 == 0, F.concat(F.lit("/o=Org"), (k % 3).cast("string"), F.lit("/cn=x"))).when(k % 5 == 1, F.lit("")).otherwise(F.concat(F.lit("U"), k.cast("string"), F.lit("@mail.dept"), (k % 4).cast("string"), F.lit(".example.com")))
    return c.select((k % 97).alias("message_id"), address.alias("address"), F.concat(F.lit("Name "), (k % 11).cast("string")).alias("display_name"), "c_custkey")


_MAPS = {
    "addresses": [("u2@mail.dept2.example.com", "personal"), ("u3@mail.dept3.example.com", "cold")],
    "domains": [("example.com", "vendor"), ("dept1.example.com", "client"), ("mail.dept2.example.com", "colleague")],
    "orgs": [("org1", "colleague")],
    "names": [("name 4", "professional-warm"), ("name 5", "personal")],
}


@query(
    "WITH r AS (SELECT c_custkey % 97 AS message_id, lower(CASE WHEN c_custkey % 5 = 0 THEN '/o=Org' || c_custkey % 3 || '/cn=x' WHEN c_custkey % 5 = 1 THEN '' ELSE 'U' || c_custkey || '@mail.dept' || c_custkey % 4 || '.example.com' END) AS a, lower('Name ' || c_custkey % 11) AS n FROM customer),"
    + ", ".join(f" {k}(key, class) AS (VALUES {', '.join(f'({sql.q(a)}, {sql.q(b)})' for a, b in v)})" for k, v in _MAPS.items())
    + ", s AS (SELECT message_id, CASE WHEN smtp IS NOT NULL THEN 'smtp' WHEN org IS NOT NULL THEN 'x500' WHEN nm IS NOT NULL THEN 'names' ELSE 'unknown' END AS stage, coalesce(smtp, org, nm, 'unknown') AS class FROM (SELECT message_id, coalesce((SELECT class FROM addresses WHERE key = a AND a LIKE '%@%'), (SELECT arg_max(class, length(key)) FROM domains WHERE a LIKE '%@' || key OR (a LIKE '%@%' AND a LIKE '%.' || key))) AS smtp, (SELECT class FROM orgs WHERE a LIKE '/o=' || key || '/%') AS org, (SELECT class FROM names WHERE key = n) AS nm FROM r)),"
    + f" p AS (SELECT message_id, count(*) AS c, min(list_position({sql.array(lex.PRECEDENCE)}, class)) AS k, count(*) FILTER (stage = 'smtp') AS smtp, count(*) FILTER (stage = 'x500') AS x500, count(*) FILTER (stage = 'names') AS names, count(*) FILTER (stage = 'unknown') AS unknown FROM s GROUP BY 1)"
    + f" SELECT message_id, CASE WHEN c >= 4 THEN 'group' ELSE ({sql.array(lex.PRECEDENCE)})[k] END AS recipient_class, CASE WHEN c >= 4 THEN '4+' WHEN c >= 2 THEN '2-3' ELSE '1' END AS count_bucket, smtp, x500, names, unknown FROM p"
)
def j05_recipient_cascade(spark, sf):
    maps = {k: spark.createDataFrame(v, "key string, class string") for k, v in _MAPS.items()}
    return rec.resolve_recipients(_recipients(spark, sf), **maps)


@query("SELECT event_id, year(t)::INT AS year, ((dayofweek(t) + 6) % 7)::INT AS weekday, (['night', 'morning', 'afternoon', 'evening'])[(hour(t) // 6 + 1)::INT] AS hour_bucket FROM (SELECT event_id, timezone('America/New_York', timezone('UTC', ts::TIMESTAMP)) AS t FROM events)")
def x25_date_fields(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", *(c.cast("string" if k == "hour_bucket" else "int").alias(k) for k, c in rec.date_fields(F.col("ts").cast("timestamp"), "America/New_York").items()))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'forward' WHEN event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 11 = 0 THEN 'reply' ELSE 'new' END AS thread_position FROM events")
def x26_thread_position(spark, sf):
    i = F.col("event_id")
    subject = F.when(i % 7 == 0, "FW: x").when(i % 3 == 0, "Re: y").otherwise("z")
    rules = F.when(i % 5 == 0, F.array(F.lit("T4"))).otherwise(F.array(F.lit("mobile-footer")))
    return table(spark, sf, "events").select("event_id", rec.thread_position(subject, i % 11 == 0, rules).alias("thread_position"))


# --- metrics ----------------------------------------------------------------------------------

_METRIC_COLUMNS = ", ".join(f"round({m} + 1e-9, 4) AS {m}" for m in tx.METRICS)


@query(f"{M} SELECT record_id, recipient_class, gated, greeting, signoff, {_METRIC_COLUMNS} FROM met")
def m01_m20_metrics(spark, sf):
    return rounded(measured(spark, sf), *tx.METRICS).select("record_id", "recipient_class", "gated", "greeting", "signoff", *tx.METRICS)


T = f"{R}, {sql.prepared('usable')}, {sql.told('prep')}"
_TELL_COLUMNS = ", ".join(f"round({m} + 1e-9, 4) AS {m}" for m in (*tx.TELLS, "paragraph_mean", "single_share"))


@query(f"{T} SELECT record_id, {_TELL_COLUMNS} FROM tel")
def t01_t18_tells(spark, sf):
    v = told(spark, sf)
    return rounded(v, *tx.TELLS, "paragraph_mean", "single_share").select("record_id", *tx.TELLS, "paragraph_mean", "single_share")


@query(f"{R} SELECT record_id, {sql.n_words(chr(34) + 'text' + chr(34))}::BIGINT AS tokens, len({sql.sentences('text')})::BIGINT AS sentences, array_to_string({sql.words('text')}, ' ') AS words, array_to_string({sql.sentences('text')}, '|') AS parts FROM rec")
def k02_k04_tokens_and_sentences(spark, sf):
    t = F.col("text")
    return rows(spark, sf).select("record_id", F.size(tx.words(t)).cast("long").alias("tokens"), F.size(tx.sentences(t)).cast("long").alias("sentences"), F.array_join(tx.words(t), " ").alias("words"), F.array_join(tx.sentences(t), "|").alias("parts"))


# --- aggregates -------------------------------------------------------------------------------


def _dist_sql(source: str, by: str = "") -> str:
    comma = f"{by}, " if by else ""
    pairs = ", ".join(f"{{'metric': '{m}', 'value': {m}}}" for m in tx.METRICS)
    at = lambda p, f="": f"round(coalesce(quantile_cont(value, {p}){f}, 0) + 1e-9, 4)"
    gated = " FILTER (gated)"
    points = "".join(f", {at(p)} AS p{round(100 * p)}" for p in stats.POINTS)
    bands = "".join(f", round(coalesce(CASE WHEN ng < 30 THEN g.b{p} ELSE s.b{p} END, 0) + 1e-9, 4) AS band_p{p}" for p in (10, 25, 75, 90))
    band = lambda: "".join(f", quantile_cont(value, {p / 100}){gated} AS b{p}" for p in (10, 25, 75, 90))
    return f"""long AS (SELECT recipient_class, gated, {comma}v.metric AS metric, v.value AS value FROM (SELECT recipient_class, gated, {comma}unnest([{pairs}]) AS v FROM {source})),
g AS (SELECT metric, count(*){gated} AS gn{band()} FROM long GROUP BY metric),
s AS (SELECT register, {comma}metric, count(*) AS n, round(avg(value) + 1e-9, 4) AS mean, round(avg((value <> 0)::INT) + 1e-9, 4) AS nonzero_share{points}{band()}, count(*){gated} AS ng FROM {ROLL.format("long")} GROUP BY ALL),
dist AS (SELECT register, {comma}s.metric, n, mean, nonzero_share, p10, p25, p50, p75, p90{bands}, CASE WHEN ng < 30 THEN gn ELSE ng END AS n_gated, ng < 30 AS fallback_global FROM s JOIN g USING (metric))"""


@query(f"{M}, {_dist_sql('met')} SELECT * FROM dist")
def register_distribution(spark, sf):
    """A01-A03, A06: the flagship."""
    return stats.distribution(measured(spark, sf))


@query(f"{M}, {_dist_sql('met', 'thread_position')} SELECT * FROM dist")
def a04_by_thread_position(spark, sf):
    return stats.distribution(measured(spark, sf), "thread_position")


S = f"{R}, pre AS (SELECT * FROM tpl WHERE confidence <> 'low'), {sql.prepared('pre')}, {sql.measured('prep')}"


def _high(spark, sf):
    return templated(spark, sf, stats.per_record).where("confidence <> 'low'")


@query(f"{S}, {_dist_sql('met', 'source')} SELECT register, source, metric, n, p50 FROM dist")
def a05_by_source(spark, sf):
    return stats.distribution(_high(spark, sf), "source").select("register", "source", "metric", "n", "p50")


def _thresholds_sql(source: str, name: str) -> str:
    pairs = ", ".join(f"{{'metric': '{m}', 'value': {m}}}" for m in tx.TELLS)
    up = f"list_contains({sql.array([m for m, d in tx.TELLS.items() if d == 'max'])}, {{0}})"
    own = f"CASE WHEN count(value) >= 30 THEN CASE WHEN {up.format('metric')} THEN greatest(quantile_cont(value, 0.9), CASE WHEN metric = 'service_phrases' THEN 1 ELSE 0 END) ELSE quantile_cont(value, 0.1) END END"
    return f"""{name}_long AS (SELECT recipient_class, v.metric AS metric, v.value AS value FROM (SELECT recipient_class, unnest([{pairs}]) AS v FROM {source})),
{name}_per AS (SELECT register, metric, count(value) AS n, round(coalesce(quantile_cont(value, 0.5), 0) + 1e-9, 4) AS p50, {own} AS own FROM {ROLL.format(name + "_long")} GROUP BY register, metric),
{name} AS (SELECT p.register, p.metric, CASE WHEN {up.format("p.metric")} THEN 'max' ELSE 'min' END AS direction, round(coalesce(p.own, g.own) + 1e-9, 4) AS threshold, p.p50, p.n, CASE WHEN p.own IS NULL AND g.own IS NOT NULL AND p.register <> '_global' THEN '_global' ELSE 'register' END AS basis FROM {name}_per p JOIN (SELECT metric, own FROM {name}_per WHERE register = '_global') g USING (metric))"""


@query(f"{T}, {_thresholds_sql('tel', 'lim')} SELECT * FROM lim")
def a07_tell_thresholds(spark, sf):
    return stats.tell_thresholds(told(spark, sf))


@query(f"{R} SELECT register, token, count(*) AS n FROM (SELECT register, lower(unnest({sql.words('text')})) AS token FROM {ROLL.format('usable')}) GROUP BY ALL")
def a08_token_frequency(spark, sf):
    return stats.token_counts(usable(spark, sf))


_REGISTERS = "(SELECT unnest(" + sql.array([*lex.CLASSES, "_global"]) + ") AS register)"


@query(f"{R}, tok AS (SELECT register, lower(unnest({sql.words('text')})) AS token FROM {ROLL.format('usable')}), tot AS (SELECT register, count(*) AS total FROM tok GROUP BY 1) SELECT register, word, round(CASE WHEN total > 0 THEN coalesce(n, 0) * 1000.0 / total ELSE 0 END, 4) AS rate FROM {_REGISTERS} CROSS JOIN (SELECT unnest({sql.array(lex.FUNCTION_WORDS)}) AS word) LEFT JOIN (SELECT register, token AS word, count(*) AS n FROM tok GROUP BY ALL) USING (register, word) LEFT JOIN tot USING (register)")
def a09_function_words(spark, sf):
    return stats.function_word_rates(usable(spark, sf))


def _phrases_sql(terms: list[str], where: str = "true") -> str:
    pairs = ", ".join(f"{{'term': {sql.q(t)}, 'c': {sql.phrase_count('text', t)}}}" for t in terms)
    return f"{R}, hit AS (SELECT register, v.term AS term, v.c AS c FROM (SELECT register, unnest([{pairs}]) AS v FROM {ROLL.format('usable')} WHERE {where})), tot AS (SELECT register, sum({sql.n_words('text')})::BIGINT AS total FROM {ROLL.format('usable')} WHERE {where} GROUP BY 1) SELECT register, coalesce(total, 0)::BIGINT AS total, term, coalesce(sum(c), 0)::BIGINT AS hits, round(CASE WHEN coalesce(total, 0) > 0 THEN coalesce(sum(c), 0) * 1000.0 / total ELSE 0 END, 4) AS rate FROM {_REGISTERS} CROSS JOIN (SELECT unnest({sql.array(terms)}) AS term) LEFT JOIN hit USING (register, term) LEFT JOIN tot USING (register) GROUP BY register, total, term"


@query(_phrases_sql([*lex.DISCOURSE, *lex.HEDGES], "eligible AND NOT sensitive AND NOT has_residual"))
def a10_discourse_and_hedges(spark, sf):
    return _long_hits(stats.phrase_hits(rec.phrase_safe(usable(spark, sf)), [*lex.DISCOURSE, *lex.HEDGES]))


def _long_hits(df):
    return df.select("register", F.col("total").cast("long").alias("total"), "term", F.col("hits").cast("long").alias("hits"), "rate")


@query(_phrases_sql(lex.LLM_ISMS))
def a13_llm_isms(spark, sf):
    return _long_hits(stats.phrase_hits(usable(spark, sf), lex.LLM_ISMS))


P = f"{R}, safe AS (SELECT * FROM usable WHERE eligible AND NOT sensitive AND NOT has_residual), {sql.prepared('safe')}"


def _forms_sql(c: str) -> str:
    return f"{P} SELECT register, {c} AS form, count(*) AS n, round(count(*)::DOUBLE / any_value(t), 4) AS share FROM {ROLL.format('prep')} JOIN (SELECT register, count(*) AS t FROM {ROLL.format('prep')} GROUP BY 1) USING (register) WHERE {c} IS NOT NULL GROUP BY ALL"


@query(_forms_sql("greeting"))
def a11_greetings(spark, sf):
    return stats.forms(tx.prepared(rec.phrase_safe(usable(spark, sf))), "greeting")


@query(_forms_sql("signoff"))
def a11_signoffs(spark, sf):
    return stats.forms(tx.prepared(rec.phrase_safe(usable(spark, sf))), "signoff")


_PAIRS = ", ".join(f"('{g}', '{b}')" for g, b, _ in lex.VARIANTS) + ", " + ", ".join(f"('{ {'ise': 'ize', 'our': 'or'}[g]}', '{a}')" for g, _, a in lex.VARIANTS)


@query(f"{R}, pair(grp, token) AS (VALUES {_PAIRS}), hit AS (SELECT register, grp, count(*) AS n FROM (SELECT register, lower(unnest({sql.words('text')})) AS token FROM {ROLL.format('usable')}) JOIN pair USING (token) GROUP BY ALL) SELECT register, grp, coalesce(n, 0) AS n FROM {_REGISTERS} CROSS JOIN (SELECT DISTINCT grp FROM pair) LEFT JOIN hit USING (register, grp)")
def a12_spelling(spark, sf):
    return stats.spelling(usable(spark, sf))


def _per_thousand(sign: str) -> str:
    return f"round(sum(len(regexp_extract_all(text, '{sign}'))) * 1000.0 / sum({sql.n_words('text')}), 4)"


@query(f"{R} SELECT register, {_per_thousand('—')} AS em, {_per_thousand('–')} AS en FROM {ROLL.format('usable')} GROUP BY 1")
def a14_dashes(spark, sf):
    return stats.dashes(usable(spark, sf))


def _ngrams_sql(size: int) -> str:
    known, function = sql.array(sorted(set(lex.common_words()))), sql.array(lex.FUNCTION_WORDS)
    return f"""{R}, safe AS (SELECT * FROM usable WHERE eligible AND NOT sensitive AND NOT has_residual), tk AS (SELECT recipient_class, {sql.words("text")} AS t FROM safe),
sp AS (SELECT recipient_class, unnest(list_transform(range(1, len(t) - {size} + 2), lambda i: t[i:i + {size - 1}])) AS span FROM tk),
g AS (SELECT recipient_class, lower(array_to_string(span, ' ')) AS phrase, count(*) AS n FROM sp WHERE len(list_filter(span, lambda w: regexp_matches(w, '^[A-Z]') AND NOT list_contains({known}, lower(w)))) = 0 AND len(list_filter(span, lambda w: NOT (list_contains({function}, lower(w)) OR starts_with(w, '[')))) > 0 GROUP BY ALL)"""


def _ranked_sql(size: int) -> str:
    g2 = lambda o, e: f"CASE WHEN {o} > 0 AND {e} > 0 THEN {o} * ln({o} / ({e})) ELSE 0 END"
    terms = " + ".join((g2("a", "(a + b) * ta / (ta + tb)"), g2("(ta - a)", "(ta + tb - a - b) * ta / (ta + tb)"), g2("b", "(a + b) * tb / (ta + tb)"), g2("(tb - b)", "(ta + tb - a - b) * tb / (ta + tb)")))
    return f"""{_ngrams_sql(size)}, al AS (SELECT phrase, sum(n) AS al FROM g GROUP BY 1), su AS (SELECT recipient_class, sum(n) AS ta FROM g GROUP BY 1), gr AS (SELECT sum(n) AS gr FROM g),
sc AS (SELECT recipient_class AS register, phrase, n::BIGINT AS n, CASE WHEN ta > 0 AND tb > 0 THEN 2 * ({terms}) ELSE 0 END AS k FROM (SELECT recipient_class, phrase, n, n::DOUBLE AS a, al::DOUBLE - n AS b, ta::DOUBLE AS ta, gr::DOUBLE - ta AS tb FROM g JOIN al USING (phrase) JOIN su USING (recipient_class) CROSS JOIN gr WHERE n >= 5) UNION ALL SELECT '_global', phrase, al::BIGINT, 0 FROM al WHERE al >= 5)
SELECT register, phrase, n, round(k, 4) AS keyness, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY register ORDER BY round(k, 6) DESC, n DESC, phrase) AS rank FROM sc) WHERE rank <= 40"""


@query(f"{_ngrams_sql(2)} SELECT recipient_class, phrase, n FROM g")
def a15_bigrams(spark, sf):
    return stats.ngrams(rec.phrase_safe(usable(spark, sf)), 2)


@query(_ranked_sql(2))
def a17_ranked_bigrams(spark, sf):
    return stats.ranked_ngrams(rec.phrase_safe(usable(spark, sf)), 2)


@query(_ranked_sql(3))
def a17_ranked_trigrams(spark, sf):
    return stats.ranked_ngrams(rec.phrase_safe(usable(spark, sf)), 3)


def _contrast_sql() -> str:
    return f"""{M}, {_dist_sql("met")}, merged AS (SELECT register, metric, round(p75 - p25, 4) AS iqr FROM dist),
pre AS (SELECT * FROM tpl WHERE confidence <> 'low'), {sql.prepared("pre", "prep2")}, {sql.measured("prep2", "met2")}, {_dist_sql("met2", "source").replace("long AS", "long2 AS").replace("FROM long ", "FROM long2 ").replace("AS register FROM long)", "AS register FROM long2)").replace("g AS (", "g2 AS (").replace(", s AS", ", s2 AS").replace("dist AS", "dist2 AS").replace(chr(10) + "s AS", chr(10) + "s2 AS").replace("FROM s JOIN g USING", "FROM s2 s JOIN g2 g USING")}
SELECT o.register, o.metric, o.source, o.p50, c.p50 AS p50_current, iqr, CASE WHEN least(o.n, c.n) < 30 THEN 'insufficient_data' WHEN abs(round(c.p50 - o.p50, 4)) > iqr THEN 'diverging' ELSE 'same' END AS status FROM dist2 o JOIN (SELECT * FROM dist2 WHERE source = 'src2') c USING (register, metric) JOIN merged USING (register, metric) WHERE o.source <> 'src2'"""


@query(_contrast_sql())
def a18_contrast(spark, sf):
    return stats.contrast(_high(spark, sf), rec.is_usable(), "src2")


@query(f"{R}, h AS (SELECT unnest([{{'field': 'year', 'value': year::VARCHAR}}, {{'field': 'recipient_class', 'value': recipient_class}}, {{'field': 'thread_position', 'value': thread_position}}]) AS v FROM usable) SELECT v.field AS field, v.value AS value, count(*) AS n FROM h WHERE v.value IS NOT NULL GROUP BY ALL")
def a19_histograms(spark, sf):
    return stats.histogram(usable(spark, sf), "year", "recipient_class", "thread_position")


@query(f"{R} SELECT source, count(*) AS records, count(*) FILTER (confidence = 'low') AS low, sum(word_count)::BIGINT AS words, min(year)::INT AS first_year, max(year)::INT AS last_year FROM rec GROUP BY 1")
def a20_summary(spark, sf):
    return stats.corpus_summary(rows(spark, sf))


@query(f"{R} SELECT record_id, word_count FROM usable WHERE word_count > (SELECT quantile_cont(word_count, 2.0 / 3) FROM usable)")
def a21_long_texts(spark, sf):
    return stats.long_texts(usable(spark, sf)).select("record_id", "word_count")


def _anchored_sql() -> str:
    def named(name: str, source: str) -> str:
        return _dist_sql(source).replace("long AS (", f"{name}_long AS (").replace("FROM long ", f"FROM {name}_long ").replace("FROM long)", f"FROM {name}_long)").replace("g AS (SELECT metric", f"{name}_g AS (SELECT metric").replace("\ns AS (", f"\n{name}_s AS (").replace("FROM s JOIN g USING", f"FROM {name}_s s JOIN {name}_g g USING").replace("dist AS", f"{name}_dist AS")

    bands = [f"band_p{p}" for p in (10, 25, 75, 90)] + ["n_gated"]
    thin = "(a.fallback_global OR a.n_gated < 30)"
    take = ", ".join(f"CASE WHEN {thin} THEN l.{c} ELSE a.{c} END AS {c}" for c in bands)
    return f"{M}, lt AS (SELECT * FROM met WHERE word_count > (SELECT quantile_cont(word_count, 2.0 / 3) FROM met)), ar AS (SELECT * FROM met WHERE recipient_class = 'personal'), {named('l', 'lt')}, {named('a', 'ar')} SELECT 'article' AS register, metric, {take}, CASE WHEN {thin} THEN 'long_emails' ELSE 'register' END AS basis FROM (SELECT * FROM a_dist WHERE register = '_global') a JOIN (SELECT * FROM l_dist WHERE register = '_global') l USING (metric)"


@query(_anchored_sql())
def a22_anchored_article(spark, sf):
    return stats.anchor_article(measured(spark, sf), F.col("recipient_class") == "personal")


@query(f"{R} SELECT source, recipient_class, count(*) AS n, count(*) FILTER (thread_position = 'new') AS new, count(*) FILTER (thread_position = 'reply') AS reply, count(*) FILTER (thread_position = 'forward') AS forward, count(*) FILTER (confidence = 'low') AS low FROM rec GROUP BY ALL")
def a24_report(spark, sf):
    count = lambda c, v: F.count_if(F.col(c) == v)
    return rows(spark, sf).groupBy("source", "recipient_class").agg(F.count("*").alias("n"), *(count("thread_position", v).alias(v) for v in ("new", "reply", "forward")), count("confidence", "low").alias("low"))


@query("SELECT domain, count(*) AS n FROM (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS domain FROM pages) GROUP BY 1 ORDER BY n DESC, domain LIMIT 50")
def a25_top_unmapped(spark, sf):
    return table(spark, sf, "pages").groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("domain")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "domain").limit(50)


# --- selection --------------------------------------------------------------------------------


@query(f"{R}, c AS (SELECT recipient_class, quantile_cont(word_count, 1.0 / 3) AS a, quantile_cont(word_count, 2.0 / 3) AS b FROM tpl GROUP BY 1) SELECT recipient_class, ((word_count > a)::INT + (word_count > b)::INT) AS stratum, count(*) AS n, count(*) FILTER (eligible AND confidence = 'high' AND NOT template AND NOT sensitive AND NOT inline_reply AND NOT has_residual AND word_count BETWEEN 8 AND 80) AS eligible FROM tpl JOIN c USING (recipient_class) GROUP BY ALL")
def p02_strata(spark, sf):
    return select.strata_counts(templated(spark, sf))


@query()
def p02_exemplars(spark, sf):
    return select.exemplars(templated(spark, sf))


@query(f"{R}, ok AS (SELECT source, recipient_class, record_id, word_count, row_number() OVER (PARTITION BY source, recipient_class ORDER BY sha256(record_id), record_id) AS k FROM tpl WHERE eligible AND confidence = 'high' AND NOT template AND NOT sensitive AND word_count <= 2000), walk AS (WITH RECURSIVE w AS (SELECT source, recipient_class, record_id, word_count, k, word_count <= 5000 AS took, CASE WHEN word_count <= 5000 THEN word_count ELSE 0 END AS used FROM ok WHERE k = 1 UNION ALL SELECT o.source, o.recipient_class, o.record_id, o.word_count, o.k, w.used + o.word_count <= 5000, w.used + CASE WHEN w.used + o.word_count <= 5000 THEN o.word_count ELSE 0 END FROM w JOIN ok o ON o.source = w.source AND o.recipient_class = w.recipient_class AND o.k = w.k + 1) SELECT * FROM w) SELECT source, recipient_class, record_id, word_count FROM walk WHERE took")
def p05_sample(spark, sf):
    return select.sample(templated(spark, sf))


@query(rf"{R} SELECT substr(sha256(record_id || i::VARCHAR), 1, 16) AS record_id, record_id AS parent_id, source, i::INT AS index, p AS text, {sql.n_words('p')}::BIGINT AS word_count FROM (SELECT record_id, source, i - 1 AS i, {sql.strip('ps[i]')} AS p FROM (SELECT record_id, source, string_split(regexp_replace({sql.strip('text')}, '\n\s*\n', chr(3), 'g'), chr(3)) AS ps FROM rec), unnest(range(1, len(ps) + 1)) AS u(i)) WHERE {sql.has_word('p')}")
def p03_paragraphs(spark, sf):
    return select.paragraph_rows(rows(spark, sf))


_CUT = rf"{R}, ps AS (SELECT record_id, source, word_count > 200 AS truncated, text, word_count, string_split(regexp_replace(text, '\n\s*\n', chr(3), 'g'), chr(3)) AS ps FROM rec), k AS (SELECT *, list_transform(range(1, len(ps) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda p: {sql.n_words('p')}))) AS ends FROM ps), c AS (SELECT *, least(coalesce(list_max(list_filter(range(1, len(ps) + 1), lambda i: ends[i] <= 200)), 0), len(ps) - 1) AS k FROM k), t AS (SELECT record_id, source, truncated, CASE WHEN truncated THEN array_to_string(ps[1:k], chr(10) || chr(10)) ELSE text END AS text FROM c)"


@query(f"{_CUT} SELECT record_id, truncated, {sql.n_words('text')}::BIGINT AS word_count FROM t")
def p06_truncated(spark, sf):
    return select.truncated(rows(spark, sf), 200).select("record_id", "truncated", "word_count")


@query(f"{_CUT}, ok AS (SELECT source, record_id, n AS word_count, row_number() OVER (PARTITION BY source ORDER BY sha256(record_id), record_id) AS k FROM (SELECT source, record_id, {sql.n_words('text')}::BIGINT AS n FROM t)), walk AS (WITH RECURSIVE w AS (SELECT source, record_id, word_count, k, word_count <= 3000 AS took, CASE WHEN word_count <= 3000 THEN word_count ELSE 0 END AS used FROM ok WHERE k = 1 UNION ALL SELECT o.source, o.record_id, o.word_count, o.k, w.used + o.word_count <= 3000, w.used + CASE WHEN w.used + o.word_count <= 3000 THEN o.word_count ELSE 0 END FROM w JOIN ok o ON o.source = w.source AND o.k = w.k + 1) SELECT * FROM w) SELECT source, record_id, word_count FROM walk WHERE took")
def p06_article_sample(spark, sf):
    return select.article_sample(rows(spark, sf), 3000, 200)


@query(f"{R} SELECT source, recipient_class, count(*) AS records, sum(word_count)::BIGINT AS words, sha256(string_agg(record_id, ',' ORDER BY record_id)) AS chunk_id FROM rec GROUP BY ALL")
def p07_chunks_by_run(spark, sf):
    return select.chunks_by_run(rows(spark, sf))


@query()
def p08_chunks_by_budget(spark, sf):
    return select.chunks_by_budget(rows(spark, sf))


@query(rf"{R} SELECT record_id, ceil(word_count * 1.8)::BIGINT + ceil((length(record_id) + 12) / 3.5)::BIGINT AS tokens FROM rec")
def p10_token_estimate(spark, sf):
    return rows(spark, sf).select("record_id", select.token_estimate(F.col("word_count"), F.char_length("record_id") + 12).alias("tokens"))


@query(f"WITH base AS ({_SQL['a09_function_words']}) SELECT register, word, rate, rank FROM (SELECT o.register, o.word, o.rate, row_number() OVER (PARTITION BY o.register ORDER BY CASE WHEN o.rate > 0 AND g.rate > 0 THEN round(abs(ln(o.rate / g.rate)), 6) WHEN g.rate > 0 THEN 1e9 ELSE 0 END DESC, o.word)::INT AS rank FROM base o JOIN (SELECT word, rate FROM base WHERE register = '_global') g USING (word) WHERE o.register <> '_global') WHERE rank <= 10")
def p12_projected_words(spark, sf):
    return stats.projected_function_words(stats.function_word_rates(usable(spark, sf)))


@query(f"{M}, {_dist_sql('met')} SELECT register, metric, n, p25, p50, p75 FROM dist")
def p12_projected_metrics(spark, sf):
    return stats.projected_metrics(stats.distribution(measured(spark, sf)))


_PICKS = f"{R}, picks AS (SELECT recipient_class AS register, record_id, word_count, row_number() OVER (PARTITION BY recipient_class ORDER BY sha256(record_id), record_id) - 1 AS pick_rank FROM tpl WHERE eligible AND confidence = 'high' AND NOT template AND NOT sensitive AND NOT inline_reply AND NOT has_residual AND word_count BETWEEN 8 AND 80)"


@query(f"{_PICKS}, few AS (SELECT * FROM picks WHERE pick_rank < 20), t AS (SELECT sum(ceil(word_count * 1.8)) AS whole FROM few) SELECT register, record_id, pick_rank::INT AS pick_rank FROM few WHERE (SELECT whole FROM t) <= 3000 OR pick_rank < 2")
def p11_token_budget(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("recipient_class").orderBy(F.sha2("record_id", 256), "record_id")
    picks = templated(spark, sf).where(rec.exemplar_eligible()).select(F.col("recipient_class").alias("register"), "record_id", "word_count", (F.row_number().over(w) - 1).alias("pick_rank"))
    return select.within_budget(picks.where("pick_rank < 20"), 3000, minimum=2).select("register", "record_id", "pick_rank")


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([^W])', '\1\1', 'g'), '(^|[^W])(?:Onthe|Ou)([^W]|$)', '\1[CAP]\2', 'g'), '([^W])[^W]', '\1', 'g') AS text FROM documents".replace("W", sql.W))
def p09_masked(spark, sf):
    residual = F.array(F.lit("Ou"), F.lit("Onthe"))
    return table(spark, sf, "documents").select("doc_id", select.masked(F.col("text"), residual).alias("text"))


_SHINGLE = "list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')))"


@query(f"{R}, tk AS (SELECT record_id, list_transform({sql.words('text')}, lambda x: lower(x)) AS t FROM rec) SELECT record_id, len({_SHINGLE})::BIGINT AS shingles FROM tk")
def c16_shingles(spark, sf):
    return rows(spark, sf).select("record_id", F.size(select.shingles(F.col("text"))).cast("long").alias("shingles"))


@query(f"SELECT a.item_id AS a, b.item_id AS b, round(CASE WHEN len(list_distinct(a.s || b.s)) > 0 THEN len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(a.s || b.s)) ELSE 0 END, 4) AS jaccard FROM (SELECT item_id, {_SHINGLE} AS s FROM (SELECT item_id, list_transform({sql.words('text')}, lambda x: lower(x)) AS t FROM benchmark)) a JOIN (SELECT item_id, {_SHINGLE} AS s FROM (SELECT item_id, list_transform({sql.words('text')}, lambda x: lower(x)) AS t FROM benchmark)) b ON b.item_id = a.item_id + 1")
def j13_jaccard(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", select.shingles(F.col("text")).alias("s"))
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("s").alias("o"))
    return b.join(nxt, "item_id").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.round(select.jaccard(F.col("s"), F.col("o")), 4).alias("jaccard"))


# --- lint -------------------------------------------------------------------------------------


def _drafts(spark, sf, turns: str = "role = 'assistant'"):
    """Turns of a role and the fixtures as drafts, half of them articles."""
    c = table(spark, sf, "conversations").where(turns).select((F.col("conv_id") * 100 + F.col("turn")).alias("draft_id"), "text")
    both = c.unionByName(fixtures.frame(spark).select(F.col("doc_id").alias("draft_id"), "text"))
    return both.withColumn("medium", F.when(F.col("draft_id") % 2 == 0, "email").otherwise("article")).withColumn("register", F.get(F.lit(lex.CLASSES), (F.col("draft_id") % 8).cast("int")))


D = f"WITH drafts AS (SELECT *, CASE WHEN draft_id % 2 = 0 THEN 'email' ELSE 'article' END AS medium, ({sql.array(lex.CLASSES)})[(draft_id % 8 + 1)::INT] AS register FROM (SELECT conv_id * 100 + turn AS draft_id, text FROM conversations WHERE role = 'assistant' UNION ALL SELECT doc_id, text FROM {fixtures.sql_values()}))"


def _counted(pattern: str, kind: str) -> str:
    if kind in ("word", "phrase"):
        return sql.phrase_count("text", pattern)
    return sql.count("text", sql.q("(?i)" + pattern)) if kind == "regex" else f"len(regexp_extract_all(text, '\\{pattern}'))"


_BAN_ROWS = " UNION ALL ".join(f"SELECT draft_id, 'rules.{b.id}' AS rule_id, '{b.severity}' AS severity, {_counted(b.pattern, b.kind)}::VARCHAR AS observed, '0' AS expected FROM drafts WHERE medium IN ({', '.join(map(sql.q, b.media))}) AND {_counted(b.pattern, b.kind)} > 0" for b in lint.BANS)


@query(f"{D} {_BAN_ROWS}")
def l02_bans(spark, sf):
    return lint.bans(_drafts(spark, sf))


@query()
def l02_locations(spark, sf):
    return lint.locations(_drafts(spark, sf))


_SUBJECTLESS = r"regexp_replace(text, '(?i)\A(?:[ \t]*\n)*[ \t]*Subject:[^\n]*(?:\n(?:[ \t]*\n)*)?', '')"

#: Letters to one register may shout once more; headings are no part of any e-mail.
_LIMITS = {"email": lint.LIMITS["email"] | {"registers": {"client": {"exclamations_max": 2}}}, "article": lint.LIMITS["article"]}
_SEEN = {"exclamations_max": sql.count("text", "'!'"), "emoji_max": f"{sql.count('text', sql.q(lex.emoji_class()))} + {sql.count('text', sql.q(':\\)|;\\)|:-\\)|:D'))}", "em_dashes_max": sql.count("text", "'—'"), "headings_allowed": "heading_use::BIGINT"}
_NAMED = {m: sorted(x.get("registers", {})) for m, x in _LIMITS.items()}
_LIMIT_ROWS = " UNION ALL ".join(f"SELECT draft_id, 'rules.{k}' AS rule_id, 'error' AS severity, ({_SEEN[k]})::VARCHAR AS observed, '{v}' AS expected FROM headed WHERE medium = '{m}' AND {f'register = {sql.q(r)}' if r else f'NOT list_contains({sql.array(_NAMED[m])}::VARCHAR[], register)'} AND ({_SEEN[k]}) > {v}" for m, r, k, v in lint.limit_rows(_LIMITS))
_HEADED = rf"lined AS (SELECT *, list_transform(string_split({_SUBJECTLESS}, chr(10)), lambda x: {sql.strip('x')}) AS hs FROM drafts), headed AS (SELECT *, (len(list_filter(range(1, len(hs) + 1), lambda i: regexp_matches(hs[i], '^#{{1,6}}[ \t]+') OR regexp_matches(hs[i], '^(?:\*\*\S(?:.*\S)?\*\*|__\S(?:.*\S)?__)$') OR (coalesce(regexp_matches(hs[i + 1], '^(?:=+|-+)$'), false) AND {sql.has_word('hs[i]')} AND NOT regexp_matches(hs[i], '^\s*(?:[-*+] |\d+\. )') AND NOT starts_with(hs[i], '>')))) > 0)::INT AS heading_use FROM lined)"


@query(f"{D}, {_HEADED} {_LIMIT_ROWS}")
def l03_limits(spark, sf):
    return lint.limits(_drafts(spark, sf), _LIMITS)


_SPELL_ROWS = " UNION ALL ".join(f"SELECT draft_id, 'rules.spelling' AS rule_id, 'error' AS severity, '{a}' AS observed, '{b}' AS expected FROM drafts WHERE {sql.phrase_count('text', a)} > 0" for _, b, a in lex.VARIANTS)


@query(f"{D} {_SPELL_ROWS}")
def l04_spelling(spark, sf):
    return lint.spelling(_drafts(spark, sf))


_TIERS = {"email": ["failed"], "article": ["ring"], "never": ["cheap"]}


@query(f"{D} " + " UNION ALL ".join(f"SELECT draft_id, 'rules.swearing' AS rule_id, 'error' AS severity, '{w}' AS observed, 'allowed tier' AS expected FROM drafts WHERE {'true' if w == 'cheap' else f'medium <> {chr(39)}{m}{chr(39)}'} AND {sql.phrase_count('text', w)} > 0" for m, ws in _TIERS.items() for w in ws))
def l05_swearing(spark, sf):
    return lint.swearing(_drafts(spark, sf), _TIERS)


DM = f"{D}, {sql.prepared('drafts')}, {sql.measured('prep')}"


@query(f"{DM} SELECT draft_id, 'stats.short_draft' AS rule_id, 'info' AS severity, round(words, 1)::DOUBLE AS observed, '80' AS expected FROM met WHERE NOT gated")
def l06_short_drafts(spark, sf):
    return lint.short(lint.measured(_drafts(spark, sf))).withColumn("observed", F.col("observed").cast("double"))


_BAND_PAIRS = ", ".join(f"{{'metric': '{m}', 'value': {m}}}" for m in tx.METRICS)


@query(f"WITH prof AS ({_SQL['register_distribution']}), dm AS ({DM} SELECT * FROM met), v AS (SELECT draft_id, register, x.metric AS metric, round(x.value, 4) AS value FROM (SELECT draft_id, register, unnest([{_BAND_PAIRS}]) AS x FROM dm WHERE gated)) SELECT draft_id, 'stats.' || metric AS rule_id, 'warn' AS severity, value AS observed FROM v JOIN prof USING (register, metric) WHERE n_gated >= 30 AND NOT value BETWEEN band_p10 AND band_p90")
def l07_bands(spark, sf):
    return lint.bands(lint.measured(_drafts(spark, sf)), stats.distribution(measured(spark, sf))).select("draft_id", "rule_id", "severity", F.col("observed").cast("double").alias("observed"))


@query(f"{R}, basis AS (SELECT sum({sql.n_words('text')}) AS total FROM usable), " + D.removeprefix("WITH ") + " " + " UNION ALL ".join(f"SELECT draft_id, 'lexicon.llm_ism' AS rule_id, CASE WHEN (SELECT sum({sql.phrase_count('text', t)}) FROM usable) = 0 AND (SELECT total FROM basis) >= 50000 THEN 'error' ELSE 'warn' END AS severity, '{t}' AS observed, 'owner wording' AS expected FROM drafts WHERE {sql.phrase_count('text', t)} > 0" for t in lex.LLM_ISMS))
def l08_llm_isms(spark, sf):
    return lint.llm_isms(_drafts(spark, sf), stats.phrase_hits(usable(spark, sf), lex.LLM_ISMS))


DT = f"{D}, body AS (SELECT * REPLACE ({_SUBJECTLESS} AS text) FROM drafts), {sql.prepared('body', 'dprep')}, {sql.told('dprep', 'dtel', 'draft_id, medium, register')}"
_TELL_PAIRS = ", ".join(f"{{'metric': '{m}', 'value': {m}}}" for m in tx.TELLS)


@query(f"WITH lims AS ({T}, {_thresholds_sql('tel', 'lim')} SELECT * FROM lim), dv AS ({DT} SELECT draft_id, register, unnest([{_TELL_PAIRS}]) AS x FROM dtel) SELECT draft_id, 'ai.' || metric AS rule_id, 'warn' AS severity, round(x.value, 4)::DOUBLE AS observed, threshold::DOUBLE AS expected FROM dv JOIN lims ON lims.register = dv.register AND lims.metric = x.metric WHERE x.value IS NOT NULL AND CASE WHEN direction = 'max' THEN round(x.value, 4) > threshold ELSE round(x.value, 4) < threshold END")
def l09_tells(spark, sf):
    found = lint.tells(lint.measured(_drafts(spark, sf)), stats.tell_thresholds(told(spark, sf)))
    return found.withColumn("observed", F.col("observed").cast("double")).withColumn("expected", F.col("expected").cast("double"))


def _articles(spark, sf):
    """Documents and fixtures as drafts of articles."""
    return table(spark, sf, "documents").unionByName(fixtures.frame(spark)).select(F.col("doc_id").alias("draft_id"), "text", F.lit("article").alias("medium"), F.lit("unknown").alias("register"))


_ARTICLES = f"WITH drafts AS (SELECT doc_id AS draft_id, text, 'article' AS medium, 'unknown' AS register FROM (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM {fixtures.sql_values()})), body AS (SELECT * REPLACE ({_SUBJECTLESS} AS text) FROM drafts), {sql.prepared('body', 'dprep')}, {sql.told('dprep', 'dtel', 'draft_id, medium, register')}"


@query(f"{_ARTICLES} SELECT draft_id, 'structure.paragraph_fragmentation' AS rule_id, 'warn' AS severity, round(paragraph_mean, 4)::DOUBLE AS observed, 3.0::DOUBLE AS expected FROM dtel WHERE round(paragraph_mean, 4) < 3 OR round(single_share, 4) > 0.15")
def l10_fragmentation(spark, sf):
    found = lint.fragmentation(lint.measured(_articles(spark, sf)))
    return found.withColumn("observed", F.col("observed").cast("double")).withColumn("expected", F.col("expected").cast("double"))


DM_BODY = f"{D}, body AS (SELECT * REPLACE ({_SUBJECTLESS} AS text) FROM drafts), {sql.prepared('body', 'dprep')}, {sql.measured('dprep', 'dmet')}"
_STRUCTURE = " UNION ALL ".join(f"SELECT draft_id, 'structure.{name}' AS rule_id, 'warn' AS severity, 'absent' AS observed, 'present' AS expected FROM dv JOIN (SELECT register, mean FROM prof WHERE metric = '{metric}') USING (register) WHERE medium = 'email' AND {metric} = 0 AND mean >= 0.6" for name, metric in (("greetings", "greeting_share"), ("signoffs", "signoff_share")))


def _letters(spark, sf):
    """Profile of the fixtures that open and close as letters do, as the register of all drafts."""
    letters = stats.distribution(stats.per_record(fixtures.frame(spark).withColumn("recipient_class", F.lit("personal"))).where("greeting is not null"))
    return letters.where(F.col("register") == stats.ALL).drop("register").crossJoin(spark.createDataFrame([(c,) for c in lex.CLASSES], "register string"))  # eight registers


_LETTERS = f"prof AS (WITH src AS (SELECT *, 'personal' AS recipient_class FROM {fixtures.sql_values()}), {sql.prepared('src', 'lprep')}, {sql.measured('lprep', 'lmet')} SELECT register, metric, mean, p90 FROM (SELECT v.metric AS metric, avg(v.value) AS mean, quantile_cont(v.value, 0.9) AS p90 FROM (SELECT unnest([{_BAND_PAIRS}]) AS v FROM lmet WHERE greeting IS NOT NULL) GROUP BY 1) CROSS JOIN (SELECT unnest({sql.array(lex.CLASSES)}) AS register))"


@query(f"WITH {_LETTERS}, dv AS ({DM_BODY} SELECT * FROM dmet) {_STRUCTURE} UNION ALL SELECT draft_id, 'structure.heading' AS rule_id, 'warn' AS severity, '1' AS observed, '0' AS expected FROM dv JOIN (SELECT register, p90 FROM prof WHERE metric = 'heading_use') USING (register) WHERE medium = 'email' AND heading_use > 0 AND p90 = 0")
def l11_structure(spark, sf):
    return lint.structure(lint.measured(_drafts(spark, sf)), _letters(spark, sf))


@query(f"WITH f AS ({D} {_BAN_ROWS}) SELECT draft_id, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warn') AS warn, count(*) FILTER (severity = 'info') AS info FROM f GROUP BY 1")
def a30_lint_summary(spark, sf):
    return lint.summary(lint.bans(_drafts(spark, sf)))


_LINES = f"SELECT draft_id, '  ' || rpad(severity, 6, ' ') || ' ' || rule_id || '  ' || observed || ' (' || expected || ')' AS line, list_position(['error', 'warn', 'info'], severity) AS rank, severity FROM f"


@query(f"WITH d AS ({D} SELECT * FROM drafts), f AS ({D} {_BAN_ROWS}), l AS ({_LINES}), s AS (SELECT draft_id, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warn') AS w, string_agg(line, chr(10) ORDER BY rank, line) AS t FROM l GROUP BY 1) SELECT draft_id, 'lint: ' || draft_id || ' (register ' || register || ', medium ' || medium || ', ' || {sql.n_words('text')} || ' words): ' || coalesce(e, 0) || ' error, ' || coalesce(w, 0) || ' warnings' || coalesce(chr(10) || t, '') AS summary FROM d LEFT JOIN s USING (draft_id)")
def l12_summary_text(spark, sf):
    drafts = _drafts(spark, sf)
    return lint.summary_text(lint.bans(drafts), drafts)


@query(f"{D} SELECT draft_id, {_SUBJECTLESS} AS text FROM drafts")
def l14_without_subject(spark, sf):
    return _drafts(spark, sf).select("draft_id", lint.without_subject(F.col("text")).alias("text"))


_HABIT_ROWS = " UNION ALL ".join(f"SELECT draft_id, 'rules.{b.id}' AS rule_id, '{b.severity}' AS severity, {_counted(b.pattern, b.kind)}::VARCHAR AS observed, '0' AS expected FROM drafts WHERE {_counted(b.pattern, b.kind)} > 0" for b in lint.HABIT_BANS)


@query(f"{D.replace('WHERE role =', 'WHERE role <>')} {_HABIT_ROWS}")
def l15_habit_bans(spark, sf):
    return lint.bans(_drafts(spark, sf, "role <> 'assistant'"), lint.HABIT_BANS)


# --- edits ------------------------------------------------------------------------------------


def _chains(spark, sf):
    """Conversations as chains: each turn is a version."""
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("chain_id"), F.col("turn").alias("version"), "text", F.when(F.col("conv_id") % 2 == 0, "llm").otherwise("owner").alias("origin"))


def _plain_sql(x: str) -> str:
    """Markdown as plain text: RE2 has no back references, so each kind of emphasis is spelt out."""
    for pattern, into, flags in (
        (r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)", "", ""),
        (r"(?s)<!--.*?-->", "", "g"),
        (r"!\[([^\]]*)\]\([^)]*\)", r"[image: \1]", "g"),
        (r"\[([^\]]+)\]\([^)]*\)", r"\1", "g"),
        (r"(?m)^\s*(?:[-*+] |\d+\. )", "", "g"),
        (r"\*\*(.+?)\*\*|__(.+?)__|\*(.+?)\*|_(.+?)_", r"\1\2\3\4", "g"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{into}', '{flags}')"
    return sql.strip(x)


@query(f"SELECT * FROM (SELECT conv_id AS chain_id, turn AS version, lag(x) OVER (PARTITION BY conv_id ORDER BY turn) AS before, x AS after FROM (SELECT conv_id, turn, {_plain_sql(chr(99) + 'oalesce(text, chr(32))')} AS x FROM conversations)) WHERE before IS NOT NULL")
def j12_version_pairs(spark, sf):
    return delta.version_pairs(_chains(spark, sf))


@query(f"SELECT chain_id, version, text, {sql.n_words('text')}::BIGINT AS word_count FROM (SELECT conv_id AS chain_id, max(turn) AS version, arg_max(x, turn) AS text FROM (SELECT conv_id, turn, {_plain_sql('coalesce(text, chr(32))')} AS x FROM conversations) GROUP BY 1)")
def p04_article_finals(spark, sf):
    return select.article_finals(_chains(spark, sf))


@query()
def a26_metric_change(spark, sf):
    return delta.metric_change(_chains(spark, sf))


def _edits(spark, sf):
    return delta.edits(delta.version_pairs(_chains(spark, sf)))


def _rewrites(spark, sf):
    """Passages as chains of two versions, the second with some words put otherwise."""
    text = F.coalesce("text", F.lit(""))
    new = text
    for a, b in (("the", "this"), ("however", "but"), ("we", "I"), ("in order to", "to")):
        new = F.regexp_replace(new, tx.phrase(a), b)
    docs = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text").unionByName(fixtures.frame(spark).select("doc_id", "text"))
    both = F.array(F.struct(F.lit(1).cast("long").alias("version"), text.alias("text")), F.struct(F.lit(2).cast("long").alias("version"), new.alias("text")))
    return docs.select(F.col("doc_id").alias("chain_id"), F.inline(both)).withColumn("origin", F.lit("llm"))


@query()
def a27_operation_counts(spark, sf):
    return delta.operation_counts(delta.operations(delta.version_pairs(_chains(spark, sf))))


@query()
def e02_e06_edits(spark, sf):
    return _edits(spark, sf).select("chain_id", "version", "index", "op", F.array_join("tags", ",").alias("tags"), F.size("swaps").alias("swaps"))


@query()
def a28_substitutions(spark, sf):
    return delta.substitutions(delta.edits(delta.version_pairs(_rewrites(spark, sf))))


@query()
def e07_examples(spark, sf):
    return delta.examples(delta.edits(delta.version_pairs(_rewrites(spark, sf))))


@query()
def e08_blind_comparison(spark, sf):
    """The first and the last version as drafts of the one before the last."""
    c = _chains(spark, sf).groupBy(F.col("chain_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("version", "text"))).alias("v"))
    at = lambda k: F.coalesce(F.get("v", k)["text"], F.lit(""))
    final = at(F.greatest(F.size("v") - 2, F.lit(0)))
    return delta.blind_comparison(c.select("id", at(F.lit(0)).alias("old_draft"), final.alias("old_final"), at(F.size("v") - 1).alias("new_draft"), final.alias("new_final")))


# --- findings ---------------------------------------------------------------------------------


def _findings(spark, sf):
    """Benchmark passages as quotes that a reader took from documents."""
    b = table(spark, sf, "benchmark").where("text is not null")
    i = F.col("item_id")
    return b.select(i.alias("finding_no"), F.get(F.lit(qual.DIMENSIONS), (i % 3).cast("int")).alias("dimension"), F.get(F.lit(lex.CLASSES), (i % 4).cast("int")).alias("register"), F.concat(F.lit("Often says "), F.array_join(F.slice(F.split("text", " "), 1, 4), " ")).alias("observation"), F.array_join(F.slice(F.split("text", " "), 2, 6), " ").alias("quote"), F.substring(F.sha2((i % 50).cast("string"), 256), 1, 16).alias("record_id"), F.get(F.lit(["high", "medium", "low"]), (i % 3).cast("int")).alias("confidence"))


_FIND = f"WITH f AS (SELECT item_id AS finding_no, ({sql.array(qual.DIMENSIONS)})[(item_id % 3 + 1)::INT] AS dimension, ({sql.array(lex.CLASSES)})[(item_id % 4 + 1)::INT] AS register, 'Often says ' || array_to_string(string_split(text, ' ')[1:4], ' ') AS observation, array_to_string(string_split(text, ' ')[2:7], ' ') AS quote, substr(sha256((item_id % 50)::VARCHAR), 1, 16) AS record_id, (['high', 'medium', 'low'])[(item_id % 3 + 1)::INT] AS confidence FROM benchmark WHERE text IS NOT NULL)"
_NORM = r"lower(regexp_replace(regexp_replace(observation, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"


@query("SELECT f.doc_id AS finding_no, substr(sha256(r.doc_id::VARCHAR), 1, 16) AS record_id FROM documents f JOIN documents r ON r.doc_id = f.doc_id - f.doc_id % 3 WHERE contains(r.text, array_to_string(string_split(f.text, ' ')[2:7], ' '))")
def j09_grounded_exact(spark, sf):
    """Words of documents as quotes, a third of them given to the right record."""
    docs = table(spark, sf, "documents")
    quotes = docs.select(F.col("doc_id").alias("finding_no"), F.array_join(F.slice(F.split("text", " "), 2, 6), " ").alias("quote"), rec.record_id((F.col("doc_id") - F.col("doc_id") % 3).cast("string")).alias("record_id"))
    return qual.grounded_exact(quotes, rows(spark, sf)).select("finding_no", "record_id")


@query()
def q01_grounded(spark, sf):
    few = _findings(spark, sf).withColumn("record_id", F.when(F.col("finding_no") % 2 == 0, F.lit("none")).otherwise(F.col("record_id")))
    return qual.ground(few, rows(spark, sf)).select("finding_no", "ratio", "dropped")


@query()
def q02_reconciled(spark, sf):
    f = _findings(spark, sf)
    prior = qual.merge(f.where("finding_no % 2 = 0"))
    return qual.reconcile(f, prior).select("finding_no", "status", "finding_id")


@query(f"{_FIND}, k AS (SELECT *, sha256(dimension || chr(0) || register || chr(0) || {_NORM}) AS finding_id FROM f) SELECT finding_id, dimension, register, count(DISTINCT record_id) AS support, count(DISTINCT (record_id, quote)) AS evidence FROM k GROUP BY ALL")
def q03_merged(spark, sf):
    return qual.merge(_findings(spark, sf)).select("finding_id", "dimension", "register", "support", "evidence")


@query(f"{_FIND}, k AS (SELECT *, sha256(dimension || chr(0) || register || chr(0) || {_NORM}) AS finding_id FROM f), m AS (SELECT finding_id, count(DISTINCT record_id) AS support, arg_min(confidence, (record_id, quote)) AS c FROM k GROUP BY ALL) SELECT finding_id, support FROM m ORDER BY support DESC, list_position(['high', 'medium', 'low'], c), finding_id LIMIT 80")
def q06_top_findings(spark, sf):
    return qual.top_findings(qual.merge(_findings(spark, sf)))


@query()
def q04_cross_register(spark, sf):
    f = _findings(spark, sf)
    return qual.cross_register(qual.merge(f), f)


@query(f"{_FIND} SELECT finding_no FROM f WHERE {sql.n_words('quote')} <= 25 AND finding_no % 5 <> 0")
def q09_parsed(spark, sf):
    f = _findings(spark, sf)
    good = F.to_json(F.struct("dimension", "register", "observation", "quote", "record_id", "confidence"))
    line = F.when(F.col("finding_no") % 5 == 0, F.lit("no json here")).otherwise(good)
    read = qual.parsed(f.select(line.alias("value")))
    return read.join(f, ["dimension", "register", "observation", "quote", "record_id", "confidence"]).select("finding_no").distinct()


@query(f"{_FIND}, sp AS (SELECT DISTINCT finding_no AS draft_id, unnest([quote, observation]) AS span FROM f), {R.removeprefix('WITH ')} SELECT draft_id, span FROM sp WHERE trim(span) <> '' AND NOT contains(span, chr(10)) AND NOT EXISTS (SELECT 1 FROM rec WHERE contains(text, span))")
def q11_absent_quotes(spark, sf):
    drafts = _findings(spark, sf).select(F.col("finding_no").alias("draft_id"), F.concat(F.lit('He said "'), "quote", F.lit('" and `'), "observation", F.lit("`.")).alias("text"))
    return qual.absent_quotes(drafts, rows(spark, sf))


@query("SELECT count(*) FILTER (item_id % 3 = 0) AS pending, count(*) FILTER (item_id % 3 = 1) AS done, count(*) FILTER (item_id % 3 = 2) AS failed FROM benchmark")
def a29_chunk_status(spark, sf):
    b = table(spark, sf, "benchmark")
    return qual.chunk_status(b.select(F.get(F.lit(["pending", "done", "failed"]), (F.col("item_id") % 3).cast("int")).alias("status")))


# --- guard and extraction -----------------------------------------------------------------------


@query(f"SELECT doc_id, len(list_filter(regexp_extract_all(text, '[{sql.W}.!#$%&''*+/=?^`{{|}}~-]+@([{sql.W}-]+(?:\\.[{sql.W}-]+)+)', 1), lambda d: NOT list_contains({sql.array(guard.RESERVED)}, lower(d)) AND NOT ends_with(lower(d), '.example'))) > 0 AS real_address FROM documents")
def g03_real_addresses(spark, sf):
    return table(spark, sf, "documents").select("doc_id", guard.real_address(F.col("text")).alias("real_address"))


# Signs that end an address are doubled, as they may begin the next one.
_PRIVATE = rf"len(list_filter(regexp_extract_all(' ' || regexp_replace(text, '([^{sql.W}.])', '\1\1', 'g') || ' ', '[^{sql.W}.]((?:\d{{1,3}}\.){{3}}\d{{1,3}})[^{sql.W}.]', 1), lambda x: len(list_filter(string_split(x, '.'), lambda p: p::INT > 255 OR (length(p) > 1 AND starts_with(p, '0')))) = 0 AND (starts_with(x, '10.') OR starts_with(x, '192.168.') OR regexp_matches(x, '^172\.(1[6-9]|2\d|3[01])\.')))) > 0"


@query(f"SELECT doc_id, {_PRIVATE} AS private_address FROM documents")
def g05_private_addresses(spark, sf):
    return table(spark, sf, "documents").select("doc_id", guard.private_address(F.col("text")).alias("private_address"))


@query("SELECT page_id, regexp_matches(path, '^raw/.*\\.jsonl$') OR regexp_matches(path, '\\.eml$') AS artifact FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'raw/a.jsonl' WHEN page_id % 4 = 1 THEN 'in/b.eml' WHEN page_id % 4 = 2 THEN 'tests/fixtures/raw/a.jsonl' ELSE 'src/x.py' END AS path FROM pages)")
def g01_artifacts(spark, sf):
    i = F.col("page_id")
    path = F.when(i % 4 == 0, "raw/a.jsonl").when(i % 4 == 1, "in/b.eml").when(i % 4 == 2, "tests/fixtures/raw/a.jsonl").otherwise("src/x.py")
    return table(spark, sf, "pages").select("page_id", guard.artifact(path).alias("artifact"))


def _name_sql(name: str) -> str:
    """A name is found where the signs around it are no word characters; one that is a common
    word only behind something on its line that ends no sentence."""
    edge = rf"(?:[^{sql.W}]|$)"
    if name.lower() in lex.common_words():
        return rf"regexp_matches(text, '[^\s.!?{sql.W}][^\S\n]*{name}{edge}|[^\s.!?][^\S\n]+{name}{edge}')"
    return rf"regexp_matches(text, '{'' if len(name) <= 3 else '(?i)'}(?:^|[^{sql.W}]){name}{edge}')"


_NAMES = ["Erthin", "The", "Ou", "Onthe"]


@query(" UNION ALL ".join(f"SELECT doc_id::VARCHAR AS id, '{n}' AS name FROM documents WHERE {_name_sql(n)}" for n in _NAMES))
def g04_name_hits(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return guard.name_hits(docs, _NAMES)


_HOSTS = rf"len(list_filter(list_zip(regexp_extract_all(x, '[^{sql.W}.-]([A-Za-z0-9][A-Za-z0-9.-]*):\d{{1,5}}[^{sql.W}]', 1), regexp_extract_all(x, '[^{sql.W}.-][A-Za-z0-9][A-Za-z0-9.-]*:(\d{{1,5}})[^{sql.W}]', 1)), lambda h: regexp_matches(h[1], '[A-Za-z]') AND NOT regexp_matches(h[1], '^\d{{4}}-\d\d-\d\dT\d\d$') AND (regexp_matches(h[1], '[.-]') OR lower(h[1]) = 'localhost' OR (length(h[2]) >= 3 AND NOT starts_with(h[2], '0'))))) > 0"
_FILES = f"WITH files AS (SELECT 'docs/' || doc_id || '.eml' AS path, coalesce(text, '') AS text, ' ' || regexp_replace(coalesce(text, ''), '([^{sql.W}.:-])', '\\1\\1', 'g') || ' ' AS x FROM documents)"


@query(f"{_FILES} SELECT path, 1 AS rule FROM files UNION ALL SELECT path, 2 FROM files WHERE contains(string_split(text, chr(10))[1], '{guard.MARKER}') UNION ALL SELECT path, 3 FROM files WHERE {_SQL['g03_real_addresses'].split('SELECT doc_id, ')[1].split(' AS real_address')[0]} UNION ALL SELECT path, 5 FROM files WHERE {_PRIVATE} OR {_HOSTS}")
def g06_scan(spark, sf):
    files = table(spark, sf, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".eml")).alias("path"), "text")
    return guard.scan(files, release=True)


@query()
def x05_x06_page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", extract.page_text("html").alias("c")).select("page_id", F.char_length("c.text").alias("n_chars"), F.array_join("c.rules", ",").alias("rules"), F.col("c.inline").alias("inline"))


@query()
def x07_x10_own_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", extract.own_text("text").alias("c")).select("doc_id", F.char_length("c.text").alias("n_chars"), F.array_join("c.rules", ",").alias("rules"), F.array_join("c.flags", ",").alias("flags"))


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?'))::BIGINT AS words, CASE WHEN len(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?')) > 3000 OR regexp_matches(text, '(?im)wrote:|^From:|^>|^Subject:') THEN 'low' ELSE 'high' END AS confidence FROM documents")
def x12_x13_flags(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", tx.word_count(t).cast("long").alias("words"), extract.confidence(extract.text_flags(t)).alias("confidence"))


@query("SELECT conv_id, turn, (least(h, p) > 10 AND abs(h - p)::DOUBLE / greatest(h, p) > 0.5) AS mismatch FROM (SELECT conv_id, turn, len(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?')) AS p, coalesce(len(regexp_extract_all(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '[A-Za-z]+(?:''[A-Za-z]+)?')), 0) AS h FROM conversations)")
def x11_mismatch(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    n = table(spark, sf, "conversations").select("conv_id", "turn", tx.word_count(F.col("text")).alias("p"), F.coalesce(F.lag(tx.word_count(F.col("text"))).over(w), F.lit(0)).alias("h"))
    return n.select("conv_id", "turn", extract.mismatch(F.col("h"), F.col("p")).alias("mismatch"))


_SENSITIVE = "|".join(lex.SENSITIVE)


@query(f"{R} SELECT record_id, regexp_matches(text, '(?i)(?:^|[^{sql.W}])(?:{_SENSITIVE})(?:[^{sql.W}]|$)') AS sensitive FROM rec")
def x22_sensitive(spark, sf):
    return rows(spark, sf).select("record_id", extract.sensitive(F.col("text")).alias("sensitive"))


@query()
def x20_scrubbed(spark, sf):
    out = extract.scrubbed(rows(spark, sf).select("record_id", "text"), ["Erthin", "Anna", "Sam"])
    return out.select("record_id", F.sha2("text", 256).alias("digest"), "greeting_names", "lexicon_names", "emails", "phones", "urls", "numbers", F.size("residual").alias("residual"))


_KNOWN = f"list_contains({sql.array(lex.GROUPS)}, lower({{0}}))"


@query(rf"""{R}, a AS (SELECT record_id, text AS t, regexp_extract(text, '^\s*([^\n]*)', 1) AS f FROM rec), b AS (SELECT *, regexp_extract(f, '{sql._POLITE}', 0) AS g0, regexp_extract(f, '{sql._POLITE}', 1) AS g1, regexp_extract(f, '{sql._BARE}', 1) AS b1 FROM a),
c AS (SELECT *, CASE WHEN g0 <> '' AND trim(g1) <> '' AND NOT {_KNOWN.format('trim(g1)')} THEN substr(g0, 1, length(g0) - length(g1) - 1) || '[NAME],' WHEN g0 = '' AND b1 <> '' AND NOT {_KNOWN.format('b1')} THEN '[NAME],' END AS h, CASE WHEN g0 <> '' THEN g0 ELSE b1 || ',' END AS o FROM b)
SELECT record_id, CASE WHEN h IS NULL THEN t ELSE substr(t, 1, strpos(t, o) - 1) || h || substr(t, strpos(t, o) + length(o)) END AS text FROM c""")
def x16_greeting_mask(spark, sf):
    return rows(spark, sf).select("record_id", extract.greeting_masked(F.col("text")).alias("text"))


@query()
def a23_signatures(spark, sf):
    """Documents end in no sign-off, so one is put on, with a line for each source."""
    signed = rows(spark, sf).withColumn("text", F.concat("text", F.lit("\nRegards,\nOwner\nHead of "), "source", F.lit("\nCall 555 0100 200")))
    return extract.learned_signatures(signed, ["Owner"])


@query()
def x15_without_signatures(spark, sf):
    signed = rows(spark, sf).withColumn("text", F.concat("text", F.lit("\nRegards,\nOwner\nHead of "), "source", F.lit("\nCall 555 0100 200")))
    out = extract.without_signatures(signed.select("record_id", "source", "year", "text"), extract.learned_signatures(signed, ["Owner"]), ("Owner",))
    return out.select("record_id", "signoff", F.array_join("rules", ",").alias("rules"), F.char_length("text").alias("n_chars"))


# Letters beyond ASCII are letters to Java's word bounds and none to RE2's, digits are to both.
@query("SELECT DISTINCT unnest(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F\\P{L}]', '0', 'g'), '\\b[A-Z][a-zA-Z]+(?:[-''][A-Z]?[a-z]+)*\\b')) AS name FROM benchmark")
def x19_name_tokens(spark, sf):
    return extract.name_tokens(table(spark, sf, "benchmark").select(F.col("text").alias("value")))


@query("SELECT DISTINCT unnest(regexp_extract_all(x, '\\b[A-Z][a-zA-Z]+\\b')) AS name FROM (SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region)")
def x19_harvest(spark, sf):
    """Nations in headers, regions in attributions and quoted headers."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    said = F.concat(F.lit("see below\nOn Mon, 1 Jan 2024, "), "r_name", F.lit(" <a@example.com> wrote:\n> old"))
    head = F.concat(F.lit("mine\nFrom: "), "r_name", F.lit(" <a@example.com>\nSent: x\nold"))
    return extract.harvested(n.select(F.array("n_name").alias("names"), F.when(F.col("n_nationkey") % 2 == 0, said).otherwise(head).alias("body")))


@query("SELECT doc_id, CASE WHEN list_position(ls, '--') IS NULL AND list_position(ls, '-- ') IS NULL THEN t ELSE array_to_string(ls[1:least(coalesce(list_position(ls, '--'), 1000000), coalesce(list_position(ls, '-- '), 1000000)) - 1], chr(10)) END AS text FROM (SELECT doc_id, t, string_split(regexp_replace(t, '\\n$', ''), chr(10)) AS ls FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || chr(10) || '-- ' || chr(10) || 'sig' ELSE text END AS t FROM documents))")
def x14_dash_cut(spark, sf):
    """Every other document with a dash line and a signature put on."""
    signed = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("\n-- \nsig"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", extract.dash_cut(signed).alias("text"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts::TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def s17_windowed_counts(spark, sf):
    from ..streaming import ingest

    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.windowed_counts(events).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("value", F.round("value", 4))
