"""Near-duplicate documents by SuperMinHash, banding, exact verification and union-find.

1. One Arrow pass turns each text into its set of 64-bit hashes of five-word shingles, a
   SuperMinHash signature and band keys. Documents with equal sets form one class, so a group
   of exact copies costs one representative however large it is.
2. Representatives meet in the buckets of their band keys. Every bucket member is compared
   with one pivot, the member that most others share buckets with; signatures prune, full sets
   decide. A bucket of k members yields k - 1 pairs.
3. Where a bucket still holds several components, members outside its largest component are
   compared with the others by signature, in blocks; what is near enough to be tested forms
   clusters, and a cluster's members are compared by full sets, in blocks, through postings of
   their shingles. Tasks return spanning links, never all pairs, and no candidate is left out.
4. Components come from union-find per partition and star contraction across partitions.

Defined cases: a null or empty text, or one of white space only, has an empty set and links
with nothing; a null doc_id links with nothing and is kept; rows that repeat a doc_id share
its component; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UnionFind, components, fields, materialize, release, splitmix, text_bytes, tune

WORDS = 5
SIMILAR = 75  # per cent
SLOTS = 256
BAND_SLOTS, BAND_ROWS = 128, 4  # 32 bands: a pair at 0.75 shares none with probability 5e-6
#: Equal slots below which a pair is not tested: over six standard deviations under the
#: threshold, so that a pair at 0.75 is lost with probability 1e-9.
LEAST_EQUAL = int(0.58 * SLOTS)
MINOR_ROWS, MAJOR_ROWS = 256, 2048

_STEP = np.uint64(0xD1342543DE82EF95)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; bytes.split() splits where the
    contract's words end, and bytes.lower() lowers A-Z alone."""
    tokens = text.lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    width = min(words, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = splitmix(out ^ h[k : k + n]) if k else splitmix(out * _STEP ^ h[:n])
    return np.unique(out)


def superminhash(values: np.ndarray, doc: np.ndarray, docs: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures (docs x slots, uint32) of the sets given as values with their document's row.

    In round j each element draws a rank and takes the next slot of its own random permutation
    of the slots; the slot keeps the least of round and rank. A document stops once all its
    slots were filled in earlier rounds, as later rounds can't lower any.
    """
    sig = np.full((docs, slots), 0xFFFFFFFF, np.uint32)
    flat = sig.reshape(-1)
    base, seeds, perm = doc.astype(np.int64) * slots, values, None
    for j in range(slots):
        x = splitmix(seeds + np.uint64((j + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        rank = (x >> np.uint64(40)).astype(np.uint32)
        k = j + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            at = k
        else:
            rows = np.arange(len(k))
            at = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
        np.minimum.at(flat, base + at, rank | np.uint32(j << 24))
        if j == slots - 1:
            break
        go = (sig >= np.uint32((j + 1) << 24)).any(axis=1)[base // slots]
        if not go.any():
            break
        if perm is None:
            k, base, seeds = k[go], base[go], seeds[go]
            perm = np.tile(np.arange(slots, dtype=np.uint8), (len(seeds), 1))
            perm[np.arange(len(k)), k] = 0
        elif not go.all():
            base, seeds, perm = base[go], seeds[go], perm[go]
    return sig


def band_keys(sig: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    bands = sig.reshape(len(sig), -1, rows).astype(np.uint64)
    key = np.arange(bands.shape[1], dtype=np.uint64)[None, :] * _STEP
    for k in range(rows):
        key = splitmix(key ^ bands[:, :, k])
    return key.view(np.int64)


FEATURES = "doc_id long, n_shingles long, digest binary, sig binary, bands array<long>"


def _features(batches):
    schema = fields(FEATURES)
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1)
        start = 0
        while start < len(ids):
            sets, size, end = [], 0, start
            while end < len(ids) and (size < 60_000 or end == start):
                sets.append(shingles(texts[end].as_py()))
                size += len(sets[-1])
                end += 1
            lens = np.array([len(s) for s in sets])
            sig = superminhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), lens), len(sets))
            keys, short = band_keys(sig[:, :BAND_SLOTS]), splitmix(sig.astype(np.uint64)).astype(np.uint8)
            some = [n > 0 for n in lens]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[start:end], pa.int64()),
                    pa.array(lens, pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if ok else None for s, ok in zip(sets, some, strict=True)], pa.binary()),
                    pa.array([r.tobytes() if ok else None for r, ok in zip(short, some, strict=True)], pa.binary()),
                    pa.array([r if ok else None for r, ok in zip(keys, some, strict=True)], pa.list_(pa.int64())),
                ],
                schema=schema,
            )
            start = end


def _sets(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], names=["doc", "set"])


def _equal_slots(batches):
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(b.num_rows, -1) for k in (2, 3))
        ok = pa.array((x == y).sum(axis=1) >= LEAST_EQUAL)
        yield b.select([0, 1]).filter(ok)


def _groups(work):
    """Feed ``work`` whole groups of rows sorted by (key, block, chunk): a table and the row
    where each group starts. A group that goes on in the next batch waits for it."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table):
            of = [rows.column(c).to_numpy() for c in ("key", "block", "chunk")]
            new = np.ones(rows.num_rows, bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in of], axis=0)
            yield from work(rows, np.flatnonzero(new))

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows = pa.Table.from_batches(held)
            same = np.all([rows.column(c).to_numpy() == rows.column(c)[-1].as_py() for c in ("key", "block", "chunk")], axis=0)
            keep = int(np.argmax(same))
            if keep:
                yield from flush(rows.slice(0, keep))
                held = rows.slice(keep).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return run


def _spanning(a: list[int], b: list[int]) -> pa.RecordBatch:
    uf = UnionFind()
    for x, y in zip(a, b, strict=True):
        uf.union(x, y)
    ties = [(x, uf.find(x)) for x in uf.up if uf.find(x) != x]
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in ties], pa.int64()), pa.array([r for _, r in ties], pa.int64())], names=["a", "b"])


def _near(rows: pa.Table, first: np.ndarray):
    """Spanning links of the pairs of a minor member and a member of another component whose
    signatures are near enough to be tested."""
    doc, comp, n, minor = (rows.column(c).to_numpy() for c in ("doc", "comp", "n", "minor"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    size = np.diff(np.append(first, rows.num_rows))
    start, size = np.repeat(first, size), np.repeat(size, size)
    minors = np.flatnonzero(minor)
    # So many minor members at once that their pairs fit in memory.
    room = np.cumsum(size[minors]) // 65_536 if len(minors) else minors
    for part in np.split(minors, np.flatnonzero(np.diff(room)) + 1):
        width = size[part]
        i = np.repeat(part, width)
        j = np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(start[part], width)
        ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= SIMILAR * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        ok = (sig[i] == sig[j]).sum(axis=1) >= LEAST_EQUAL
        yield _spanning(doc[i[ok]].tolist(), doc[j[ok]].tolist())


def _exact(rows: pa.Table, first: np.ndarray):
    """Spanning links of a cluster's pairs of different components that reach the threshold by
    their full sets. Postings of the shingles give a member's overlaps with all others at once."""
    doc, comp, minor = (rows.column(c).to_numpy() for c in ("doc", "comp", "minor"))
    sets = rows.column("set").combine_chunks()
    offset, values = sets.offsets.to_numpy(), sets.values.to_numpy()
    for s, e in zip(first, np.append(first[1:], len(doc)), strict=True):
        at = offset[s : e + 1] - offset[s]
        _, term = np.unique(values[offset[s] : offset[e]], return_inverse=True)
        owner = np.repeat(np.arange(e - s), np.diff(at))
        order = np.argsort(term, kind="stable")
        holders, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(term))])
        n, own = np.diff(at), comp[s:e]
        a, b = [], []
        for i in np.flatnonzero(minor[s:e]):
            mine = term[at[i] : at[i + 1]]
            width = begin[mine + 1] - begin[mine]
            where = np.arange(width.sum()) + np.repeat(begin[mine] - (np.cumsum(width) - width), width)
            shared = np.bincount(holders[where], minlength=e - s)
            hit = np.flatnonzero((100 * shared >= SIMILAR * (n[i] + n - shared)) & (own != own[i]))
            a += [int(doc[s + i])] * len(hit)
            b += doc[s + hit].tolist()
        yield _spanning(a, b)


def _blocks(rows: DataFrame, keep: list[str]) -> DataFrame:
    """rows (key, doc, comp, ...) of keys that hold several components, dealt so that every
    member outside the key's largest component meets every member, in groups of bounded size."""
    per = rows.groupBy("key", "comp").agg(F.count("*").alias("k"))
    major = per.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("m"), F.sum("k").alias("size")).where("comps > 1")
    major = major.select("key", F.col("m.comp").alias("main"), F.ceil((F.col("size") - F.col("m.k")) / MINOR_ROWS).cast("int").alias("blocks"), F.ceil(F.col("size") / MAJOR_ROWS).cast("int").alias("chunks"))
    rest = rows.join(major, "key")
    place = lambda n, salt: F.pmod(F.xxhash64("doc", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    minor = rest.where("comp <> main").select("key", "doc", "comp", *keep, F.lit(True).alias("minor"), place("blocks", 0).alias("block"), every("chunks").alias("chunk"))
    other = rest.select("key", "doc", "comp", *keep, F.lit(False).alias("minor"), every("blocks").alias("block"), place("chunks", 1).alias("chunk"))
    return minor.unionByName(other).repartition("key", "block", "chunk").sortWithinPartitions("key", "block", "chunk")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    left = pairs.join(sets.select(F.col("doc").alias("b"), F.col("set").alias("sb")), "b")
    both = left.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= SIMILAR * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    tune(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    feats, _ = materialize(source.mapInArrow(_features, FEATURES), "features")
    some = feats.where("n_shingles > 0 and doc_id is not null")
    reps = some.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    rep_feats = some.join(reps.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi")
    rep_feats, reps_at = materialize(rep_feats.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "sig", "bands").dropDuplicates(["doc"]), "reps")

    keys = rep_feats.select("doc", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets, buckets_at = materialize(keys.join(shared, "key"), "buckets")
    weight = buckets.groupBy("doc").agg(F.sum("members").alias("w"))
    pivots = buckets.join(weight, "doc").groupBy("key").agg(F.max(F.struct(F.col("w"), (-F.col("doc")).alias("m"))).alias("p")).select("key", (-F.col("p.m")).alias("pivot"))
    star = buckets.join(pivots, "key").where("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b"), "members")
    star = star.groupBy("a", "b").agg(F.max("members").alias("members"))
    sigs = rep_feats.select("doc", "sig")
    met = star.join(sigs.select(F.col("doc").alias("b"), F.col("sig").alias("y")), "b").join(sigs.select(F.col("doc").alias("a"), F.col("sig").alias("x")), "a")
    pairs, pairs_at = materialize(met.select("a", "b", "x", "y").mapInArrow(_equal_slots, "a long, b long"), "pairs")
    # Whoever may still link: near a pivot, or in a bucket where it isn't near the pivot but others might be near it.
    far = star.where("members > 2").join(pairs, ["a", "b"], "left_anti").select(F.col("b").alias("doc"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc")).union(far).distinct()
    sets, sets_at = materialize(source.withColumnRenamed("doc_id", "doc").join(wanted, "doc", "left_semi").dropDuplicates(["doc"]).mapInArrow(_sets, "doc long, set array<long>"), "sets")
    links, links_at = materialize(_verified(pairs, sets), "found")
    comps, comp_at = components(links)
    temporary = [reps_at, buckets_at, pairs_at, sets_at, links_at]

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(comps.select(F.col("v").alias("doc"), "r"), "doc", "left").withColumn("comp", F.coalesce("r", "doc")).drop("r")

    active = labelled(buckets.select("key", "doc").join(sets.select("doc"), "doc", "left_semi")).join(rep_feats.select("doc", "n", "sig"), "doc")
    near, near_at = materialize(_blocks(active, ["n", "sig"]).mapInArrow(_groups(_near), "a long, b long"), "near")
    clusters, cluster_at = components(near)
    members = clusters.select(F.col("v").alias("doc"), F.col("r").alias("key")).union(clusters.select("r", "r").distinct())
    tested = _blocks(labelled(members).join(sets, "doc"), ["set"]).mapInArrow(_groups(_exact), "v long, r long")
    comps, _ = components(comps.unionByName(tested))
    temporary += [near_at, *cluster_at, *comp_at]
    release(spark, *temporary)

    rooted = reps.join(comps.select(F.col("v").alias("rep"), "r"), "rep", "left").select("digest", F.coalesce("r", "rep").alias("root"))
    out = feats.select("doc_id", "n_shingles", "digest").join(rooted, "digest", "left")
    # A doc_id on several rows may have several roots: it reaches them all, so the smallest holds.
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))
