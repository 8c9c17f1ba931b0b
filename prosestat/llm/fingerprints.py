"""SimHash fingerprints and permuted block tables.

A text's terms are its distinct word trigrams and words, and for short texts its character
4-grams; each term's 128-bit hash votes on every bit with the term's weight, and the signs of
the sums are the fingerprint. All fingerprints within a Hamming radius are found exactly: the bits
are cut into ``BLOCKS`` blocks, and each block, permuted to the front, gives a table keyed by
it. Of two fingerprints within the radius, at least one block differs in at most
radius // BLOCKS bits, so a query looks up every block of its own with all sets of so many bits
flipped. Stored fingerprints take BLOCKS rows each, whatever the radius; only queries, a stated
few, grow with it.

Defined cases: a null text counts as empty, and the empty text has the all-zero fingerprint;
equal texts have equal fingerprints; a null doc_id sorts first; rows that repeat a doc_id are
ordered by text; the only document of a table is its own next document; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, fields, id_cuts, materialize, splitmix, tune

BITS = 128
BLOCKS = 4
#: From measured distances: one changed word moves 6 to 9 bits of most texts (see the README).
RADIUS = 11
SHORT_WORDS = 48
#: Documents that one sorted bucket aims at, at most.
BUCKET_ROWS = 50_000
#: Rows of one block's value beyond which they are dealt over several salts.
HOT_ROWS = 20_000


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit term hashes and their weights."""
    raw = text.encode()
    tokens = raw.lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    three = splitmix(splitmix(splitmix(h[:-2]) ^ h[1:-1]) ^ h[2:]) if len(h) > 2 else h[:0]
    grams = np.empty(0, np.uint64)
    if len(tokens) < SHORT_WORDS:
        b = np.frombuffer(raw, np.uint8).astype(np.uint64)
        n = max(1, len(b) - 3) if len(b) else 0
        if n:
            b = np.pad(b, (0, max(0, 4 - len(b))))
            grams = splitmix(b[:n] | b[1 : n + 1] << np.uint64(8) | b[2 : n + 2] << np.uint64(16) | b[3 : n + 3] << np.uint64(24) | np.uint64(1 << 40))
    words, tf = np.unique(h, return_counts=True)
    rest, tr = np.unique(np.concatenate([three, grams]), return_counts=True)
    # Single words are shared by unrelated texts, so they weigh less than sequences.
    return np.concatenate([words, rest]), np.concatenate([0.25 * (1 + np.log(tf)), 1 + np.log(tr)]).astype(np.float32)


def simhash(text: str, bits: int = BITS) -> bytes:
    h, w = terms(text)
    if not len(h):
        return bytes(bits // 8)
    votes = np.zeros(bits, np.float32)
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096]
        wide = np.stack([splitmix(part + np.uint64(0x51ED270B * (k + 1))) for k in range(bits // 64)], axis=1)
        on = np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1)
        votes += 2 * (w[i : i + 4096] @ on.astype(np.float32)) - w[i : i + 4096].sum()
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and the next document's text.

    Documents are dealt into buckets at quantiles of doc_id; each bucket also gets the first
    document of the next bucket, so every bucket finds its successors alone.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.count()
    cuts = id_cuts(rows, "doc_id", max(min(least, total), -(-total // BUCKET_ROWS)))  # one long for each bucket
    rows = rows.withColumn("bucket", bucket_of(F.col("doc_id"), cuts))
    is_cut = (F.col("bucket") > 0) & (F.col("doc_id") == F.get(F.lit(cuts), F.col("bucket") - 1)) if cuts else F.lit(False)
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("spare"))
    before = F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(True).alias("spare"))
    dealt = rows.select("doc_id", "text", F.explode(F.when(is_cut, F.array(own, before)).otherwise(F.array(own))).alias("b")).select("doc_id", "text", "b.*")
    # After the last document comes the first one.
    first = rows.orderBy("doc_id", "text").limit(1)
    dealt = dealt.union(first.select("doc_id", "text", F.lit(len(cuts)).alias("bucket"), F.lit(True).alias("spare")))
    w = Window.partitionBy("bucket").orderBy("spare", "doc_id", "text")
    out = dealt.select("doc_id", "text", "spare", F.lead("text").over(w).alias("next"))
    return out.where("not spare").select("doc_id", "text", "next")


ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of ROWS for every row of docs (doc_id, text)."""
    tune(docs.sparkSession)

    def make(batches):
        last: tuple[str, bytes] = ("", simhash(""))
        for b in batches:
            out = []
            ids, texts, follow = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for i, t, nxt in zip(ids, texts, follow, strict=True):
                own = last[1] if t == last[0] else simhash(t)
                head = nxt[: len(t) // 4]
                edited = t[: len(t) - len(t) // 4] + head
                e = simhash(edited)
                last = (nxt, simhash(nxt))
                out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), own.hex(), e.hex(), likeness(own, e), likeness(own, last[1])))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind.type) for c, kind in zip(zip(*out, strict=True), fields(ROWS), strict=True)], schema=fields(ROWS)) if out else pa.RecordBatch.from_pylist([], schema=fields(ROWS))

    return with_next(docs).mapInArrow(make, ROWS)


def _halves(fingerprint: str) -> list[Column]:
    """The fingerprint's 64-bit halves, hi and lo."""
    word = lambda k: F.conv(F.substring(fingerprint, 1 + 8 * k, 8), 16, 10).cast("long")
    return [F.shiftleft(word(2 * k), 32).bitwiseOR(word(2 * k + 1)).alias(n) for k, n in enumerate(("hi", "lo"))]


def tables(prints: DataFrame, flips: int = 0) -> DataFrame:
    """The block tables of (hi, lo): a row for each block with its key, or for each block and
    set of at most ``flips`` of its bits flipped."""
    width = BITS // BLOCKS
    masks = [sum(1 << b for b in at) for n in range(flips + 1) for at in combinations(range(width), n)]
    whole = F.lit((1 << width) - 1)
    blocks = F.array(*(F.shiftrightunsigned(h, 32 * (1 - k)).bitwiseAND(whole) for h in ("hi", "lo") for k in range(2)))
    rows = prints.select("hi", "lo", F.posexplode(blocks).alias("block", "bits"))
    rows = rows.select("hi", "lo", F.shiftleft(F.col("block").cast("long"), width).alias("b"), "bits")
    if not flips:
        return rows.select("hi", "lo", F.col("b").bitwiseOR(F.col("bits")).alias("key"))
    flipped = F.transform(F.lit(masks), lambda m: F.col("b").bitwiseOR(F.col("bits").bitwiseXOR(m.cast("long"))))
    return rows.select("hi", "lo", F.explode(flipped).alias("key"))


def within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (query, fingerprint, distance) of distinct fingerprints at most ``radius`` apart,
    exact: every fingerprint of ``queries`` against every one of ``prints``."""
    q = tables(queries.select("fingerprint").distinct().select(*_halves("fingerprint")), radius // BLOCKS).toDF("qhi", "qlo", "key")
    stored, _ = materialize(tables(prints.select("fingerprint").distinct().select(*_halves("fingerprint"))), "blocks")
    # Values of a block that very many texts share: at most BLOCKS / HOT_ROWS of all rows.
    hot = stored.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("key", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("salts"))
    if hot.limit(1).count():
        salts = F.coalesce("salts", F.lit(1))
        stored = stored.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("hi", "lo"), salts).cast("int")).drop("salts")
        q = q.join(hot, "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        met = q.hint("merge").join(stored, ["key", "salt"])
    else:
        # The planner takes the lookups for few, as it doesn't see that they are exploded.
        met = q.hint("merge").join(stored, "key")
    apart = F.bit_count(F.col("qhi").bitwiseXOR(F.col("hi"))) + F.bit_count(F.col("qlo").bitwiseXOR(F.col("lo")))
    near = met.withColumn("distance", apart).where(F.col("distance") <= radius).select("qhi", "qlo", "hi", "lo", "distance").distinct()
    text = lambda a, b: F.lower(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(h, 32 * (1 - k)).bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for h in (a, b) for k in range(2))))
    return near.select(text("qhi", "qlo").alias("query"), text("hi", "lo").alias("fingerprint"), "distance")


def search(prints: DataFrame, radius: int = RADIUS, every: int = 100) -> DataFrame:
    """prints with n_near: for documents whose id is divisible by ``every``, how many other
    documents lie within the radius; null for the rest."""
    queries = prints.where(F.col("doc_id") % every == 0)
    sizes = prints.groupBy("fingerprint").agg(F.count("*").alias("copies"))
    found = within(queries, prints, radius).join(sizes, "fingerprint").groupBy("query").agg(F.sum("copies").alias("near"))
    out = prints.join(found.withColumnRenamed("query", "fingerprint"), "fingerprint", "left")
    return out.select(*prints.columns, F.when(F.col("doc_id") % every == 0, F.col("near") - 1).alias("n_near"))


def query(docs: DataFrame) -> DataFrame:
    prints, _ = materialize(fingerprints(docs), "prints")
    return search(prints)
