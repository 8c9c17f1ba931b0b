"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, fingerprints, minhash_dedup, mixing, pii, quality, secret_scan, token_files, tokens, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.query(_table(spark, sf_dir, "documents"))


def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.query(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_minhash_dedup, op2_quality_knn, op3_simhash, op4_pii_crf, op5_byte_bpe, op6_source_mix, op7_secret_scan, op8_token_files, op9_embedding_dedup, op10_url_filter]
    return {f.__name__: f for f in found}


_REACH = """reach AS (WITH RECURSIVE r(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, links.b FROM r JOIN links ON links.a = r.b) SELECT a AS id, min(b) AS low FROM r GROUP BY 1)"""

OP1_SQL = f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
u AS (SELECT doc_id, unnest(s) AS x FROM s), n AS (SELECT doc_id, len(s) AS n FROM s),
pair AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM u p JOIN u q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)), {_REACH}
SELECT doc_id, n::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept FROM n LEFT JOIN reach ON id = doc_id"""

OP9_SQL = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.95), {_REACH}
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept FROM v LEFT JOIN reach ON id = vec_id LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY 1) c ON c.a = vec_id"""


def _op7_sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rules = secret_scan.RULES
    columns = []
    for k, r in enumerate(rules):
        p = q(("(?i)" if r.ignore_case else "") + r.pattern)
        columns.append(f"regexp_extract_all(t, {p}) AS m{k}, regexp_extract_all(t, {p}, {r.group}) AS c{k}, string_split_regex(t, {p}) AS g{k}")
    before = lambda k: f"coalesce(list_sum(list_transform(g{k}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m{k}[1:i - 1], lambda x: length(x))), 0)"
    found = " || ".join(f"list_transform(list_filter(range(1, len(m{k}) + 1), lambda i: length(c{k}[i]) >= {r.least}), lambda i: {{'a': ({before(k)})::BIGINT, 'k': {k}, 'b': ({before(k)})::BIGINT + length(m{k}[i])}})" for k, r in enumerate(rules))
    kinds = "[" + ", ".join(q(r.kind) for r in rules) + "]"
    say = lambda x: f"array_to_string(list_transform(list_sort({x}), lambda s: ({kinds})[s.k + 1] || ':' || s.a || ':' || s.b), ',')"
    base = [k for k, r in enumerate(rules) if r.base]
    counts = ", ".join(f"len(list_filter(f, lambda s: s.k = {k}))::BIGINT AS n_{rules[k].kind}" for k in base)
    own = f"list_filter(f, lambda s: s.k <= {max(base)})"
    return f"WITH d AS (SELECT doc_id, {', '.join(columns)} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)), f AS (SELECT doc_id, {found} AS f FROM d) SELECT doc_id, {counts}, sha256({say(own)}) AS base_sha256, {say('f')} AS spans FROM f"


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1_SQL, "op7_secret_scan": _op7_sql(), "op9_embedding_dedup": OP9_SQL}
