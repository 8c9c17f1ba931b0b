"""Byte-level BPE: overlapping chunk encoding and raw-byte decoding.

A long text is cut into chunks that overlap; chunks are rows, so their pre-tokens are found in
parallel. Pre-token boundaries of neighbouring chunks are compared in the overlap: at the first
place where both have one and the text after it is the same for both, they have resynchronised
(the matcher keeps no state across a boundary), and the text is cut there. Where an overlap has
no common boundary the two chunks are joined. The resulting pieces begin and end at true
pre-token boundaries, so encoding them apart gives the ids of the whole text.

Pre-tokens of short texts run through a bounded cache of word-sized parts, which a task empties
at its end, as its Python worker lives on. Decoding concatenates the raw bytes of the ids.

Defined cases: a null text counts as empty and has no ids; special-token strings are ordinary
text; rows that repeat a doc_id give one row each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fields, give_back, materialize, tune

CHUNK = 1 << 16
OVERLAP = 1 << 10
CACHE = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Numbered(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, ids per list)."""
    lens = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens


def gathered(flat: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, ids per run) of the runs numbered ``at``; run k is flat[starts[k] : starts[k + 1]]."""
    lens = starts[at + 1] - starts[at]
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts[at] - (ends - lens), lens)], lens


class PartCache:
    """Ids of parts of text, encoded once and gathered as arrays; cleared when full."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = CACHE) -> None:
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.index = Numbered()
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per part)."""
        if len(self.index) > self.most:
            self.clear()
        known = len(self.index)
        at = np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))
        if len(self.index) > known:
            try:
                flat, lens = self.encode(list(islice(self.index, known, None)))
            except BaseException:
                self.clear()  # of parts that have a number but no ids
                raise
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lens)])
            self.flat = np.concatenate([self.flat, flat])
        return gathered(self.flat, self.starts, at)


class ByteBpe:
    """Encoder and decoder for one ranks file and pre-token pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.bytes_of[r] = t
        self.cache = PartCache(lambda parts: flattened([self.bpe.encode_ordinary(p) for p in parts]))

    def boundaries(self, text: str, start: int = 0) -> list[int]:
        return [m.start() for m in self.pattern.finditer(text, start)]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. A single space after a visible character always begins a pre-token,
        so texts whose white space is only such spaces and line ends apart from them are cut
        there and their parts looked up; any other text is encoded whole."""
        parts: list[str] = []
        counts = []
        for t in texts:
            if not t or t[0] == " " or t[-1] == " " or "  " in t or " \n" in t or "\n " in t or RARE_SPACE.search(t):
                counts.append(-1)
                continue
            cut = t.split(" ")
            parts.append(cut[0])
            parts += [" " + c for c in cut[1:]]
            counts.append(len(cut))
        flat, lens = self.cache.ids(parts)
        ends = np.concatenate([[0], np.cumsum(lens)])
        out, p = [], 0
        for t, n in zip(texts, counts, strict=True):
            if n < 0:
                out.append(np.array(self.bpe.encode_ordinary(t), np.uint32))
            else:
                out.append(flat[ends[p] : ends[p + n]])
                p += n
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


#: White space other than the space and the line feed.
RARE_SPACE = regex.compile(r"[^\S \n]")

_OPEN: dict[tuple[str, str], ByteBpe] = {}


def opened(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = ByteBpe(path, pattern)
    return _OPEN[path, pattern]


def cut_chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, str]]:
    """(start, text) of overlapping chunks; the last one reaches the end."""
    step, start = chunk - overlap, 0
    while True:
        yield start, text[start : start + chunk]
        if start + chunk >= len(text):
            return
        start += step


def chunk_bounds(bpe: ByteBpe, start: int, text: str, last: bool, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], list[int]]:
    """Boundaries in the overlap with the chunk before and with the chunk after, as offsets in
    the whole text. Only where a match ends can depend on what follows the chunk, never where
    one starts, so all starts count."""
    at = bpe.boundaries(text)
    head = [start + p for p in at if p < overlap] if start else []
    tail = [] if last else [start + p for p in at if p >= chunk - overlap]
    return head, tail


CHUNKS = "row long, doc_id long, chunk int, start long, last boolean, text string"
BOUNDS = "row long, chunk int, start long, head array<long>, tail array<long>"
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _out(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields(OUT), strict=True)], schema=fields(OUT))


def digest(bpe: ByteBpe, ids: np.ndarray) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()


def long_pieces(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Pieces (row, doc_id, piece, ids as little-endian uint32) of texts of over ``chunk`` code
    points (row, doc_id, text)."""

    def cut(batches):
        kinds = re.findall(r"(\w+) (\w+)", CHUNKS)
        for b in batches:
            for row, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k, (start, part) in enumerate(cut_chunks(text, chunk, overlap)):
                    yield pa.RecordBatch.from_pylist([dict(zip((n for n, _ in kinds), (row, doc, k, start, start + chunk >= len(text), part), strict=True))], schema=fields(CHUNKS))

    def bounds(batches):
        bpe = opened(path, pattern)
        for b in batches:
            rows = []
            for row, k, start, last, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                head, tail = chunk_bounds(bpe, start, text, last, chunk, overlap)
                rows.append({"row": row, "chunk": k, "start": start, "head": head, "tail": tail})
            yield pa.RecordBatch.from_pylist(rows, schema=fields(BOUNDS))

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        bpe = opened(path, pattern)
        rows = rows.sort_values("chunk")
        ids = np.array(bpe.bpe.encode_ordinary("".join(rows["text"])), np.uint32)
        return pd.DataFrame({"row": rows["row"].iloc[:1], "doc_id": rows["doc_id"].iloc[:1], "piece": rows["piece"].iloc[:1], "ids": [ids.astype("<u4").tobytes()]})

    chunks, _ = materialize(docs.mapInArrow(cut, CHUNKS).repartition(F.col("row"), F.col("chunk")), "chunks")
    w = Window.partitionBy("row").orderBy("chunk")
    met = chunks.select("row", "chunk", "start", "last", "text").mapInArrow(bounds, BOUNDS)
    met = met.withColumn("cut", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("tail").over(w), F.col("head")))))
    # From the first overlap without a common boundary on, the rest of the text is one piece.
    met = met.withColumn("open", F.max(F.col("cut").isNull()).over(w)).withColumn("next_open", F.lead("open").over(w)).withColumn("next_cut", F.lead("cut").over(w))
    met = met.select(
        "row",
        "chunk",
        F.sum(F.when(F.col("open"), 0).otherwise(1)).over(w).cast("int").alias("piece"),
        F.when(F.col("open"), F.lit(overlap)).otherwise(F.col("cut") - F.col("start")).cast("int").alias("lo"),
        F.when(F.col("next_open"), F.lit(chunk)).when(F.col("next_cut").isNotNull(), F.col("next_cut") - F.col("start")).otherwise(F.lit(chunk)).cast("int").alias("hi"),
    )
    slices = chunks.join(met, ["row", "chunk"]).select("row", "doc_id", "piece", "chunk", F.substring("text", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("text"))
    return slices.groupBy("row", "piece").applyInPandas(encode, "row long, doc_id long, piece int, ids binary")


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of docs (doc_id, text) the columns of OUT."""
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.char_length("text") > chunk

    def short(batches):
        bpe = opened(path, pattern)
        try:
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                yield _out([(i, *digest(bpe, t)) for i, t in zip(ids, bpe.encode_many(texts), strict=True)])
        finally:
            bpe.cache.clear()
            give_back()

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        bpe = opened(path, pattern)
        ids = np.frombuffer(b"".join(rows.sort_values("piece")["ids"]), "<u4")
        doc = rows["doc_id"].iloc[0]
        return pd.DataFrame([(None if pd.isna(doc) else int(doc), *digest(bpe, ids))], columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64"})

    small = rows.where(~is_long).mapInArrow(short, OUT)
    pieces = long_pieces(rows.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), path, pattern, chunk, overlap)
    return small.union(pieces.groupBy("row").applyInPandas(join, OUT))
