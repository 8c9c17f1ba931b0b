"""Token ids in Arrow stream files of equal-length sequences.

Documents are dealt by ranges of doc_id (and a hash of the text, for ids that repeat), sorted
and encoded, so each shard holds a run of the table in ascending order. A shard is one file in Arrow's random-access stream format: every
batch has ``SEQUENCES`` rows of a fixed-size list of token ids and one of a mask, so sequence k
is at a computed place and memory-mapping reads it without a copy. Documents follow each other
without padding; only a shard's last sequence is padded, with mask 0. An index table has each
document's shard, its place in the shard and in the whole table, and its length.

A file is written under the task attempt's own name and then renamed, so a repeated task
replaces it by an equal one.

Defined cases: a null or empty text is its end id alone; a null doc_id sorts first; rows that
repeat a doc_id are ordered by a hash of their texts; special-token strings give their special ids, as
in the library; other columns are ignored; an empty table writes no file.
"""

from __future__ import annotations

import os
import re
import zlib
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import fields, fresh_path, give_back, materialize, tune
from .tokens import Numbered, PartCache, flattened, gathered

END_ID = 1
LENGTH = 2048
SEQUENCES = 64
SHARD_BYTES = 128 << 20  # of input, aimed at for each file
WIDTH = pa.uint16()  # 49,408 ids
CACHE = 1_000_000  # parts
GROUP = 400  # parts encoded in one text
LETTERS = frozenset(ascii_letters)
#: Words of letters that normalising leaves alone but for their case.
PLAIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+")

_OPEN: dict[str, WordCache] = {}


class WordCache(PartCache):
    """Parts that end in one closing mark after an ASCII letter are the part without it and the
    mark: the tokenizer always cuts there. (After other letters it may not: normalising can end
    them in a combining mark, which goes with the closing one.) New parts are encoded many in
    one text: plain words, in lower case, one after the other, and others between marks that
    none of them holds."""

    def __init__(self, tokenizer: Tokenizer, most: int = CACHE) -> None:
        self.tokenizer = tokenizer
        (self.mark,) = self.whole(["\0"])[0]
        self.ends = {c: ids for c in ".,!?" for ids in self.whole([c])[0]}
        vocabulary = tokenizer.get_vocab()
        self.closing = np.zeros(1 + max(vocabulary.values()), bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        super().__init__(self.fresh, most)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per part) of plain words, of which each ends in its one closing id."""
        flats, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(parts), GROUP):
            flat = np.array(self.whole([" ".join(parts[k : k + GROUP])])[0], np.uint32)
            flats.append(flat)
            lens.append(np.diff(np.flatnonzero(self.closing[flat]), prepend=-1))
        return np.concatenate(flats), np.concatenate(lens)

    def many(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per part) of any parts."""
        flats, lens = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(parts), GROUP):
            part = parts[k : k + GROUP]
            text = " \0 ".join(part)
            if text.count("\0") == len(part) - 1:
                flat = np.array(self.whole([text])[0], np.uint32)
                marks = flat == self.mark
                flats.append(flat[~marks])
                lens.append(np.diff(np.flatnonzero(marks), prepend=-1, append=len(flat)) - 1)
            else:
                flat, n = flattened(self.whole(part))
                flats.append(flat)
                lens.append(n)
        return np.concatenate(flats), np.concatenate(lens)

    def fresh(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        stems = [p[:-1] if p[-1] in self.ends and p[-2:-1] in LETTERS else p for p in parts]
        # A stem has ids already, as a part of an earlier call, or gets them here.
        words, others, known, get, plain = Numbered(), Numbered(), len(self.starts) - 1, self.index.get, PLAIN.fullmatch
        at = np.array([i if (i := get(s, known)) < known else known + words[s.lower()] if plain(s) else -1 - others[s] for s in stems], np.int64)
        at = np.where(at < 0, known + len(words) - 1 - at, at)
        (flat, lens), (more, n) = self.words(list(words)), self.many(list(others))
        starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate([lens, n]))])
        flat, lens = gathered(np.concatenate([self.flat, flat, more]), starts, at)
        closed = np.array([s is not p for s, p in zip(stems, parts, strict=True)], bool)
        marks = np.array([self.ends[p[-1]] for s, p in zip(stems, parts, strict=True) if s is not p], np.uint32)
        return np.insert(flat, np.cumsum(lens)[closed], marks), lens + closed


def opened(path: str) -> WordCache:
    if path not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _OPEN[path] = WordCache(Tokenizer.from_file(path))
    return _OPEN[path]


def encode_many(cache: WordCache, texts: list[str], end_id: int = END_ID) -> list[np.ndarray]:
    """Ids of each text and the end id. The tokenizer drops white space and nothing in it
    reaches across, neither normalising nor a special-token string, so parts between spaces and
    line feeds are encoded apart."""
    parts: list[str] = []
    counts = []
    for t in texts:
        cut = [p for p in t.replace("\n", " ").split(" ") if p]
        parts += cut
        counts.append(len(cut))
    flat, lens = cache.ids(parts)
    ends = np.concatenate([[0], np.cumsum(lens)])
    out, p = [], 0
    for n in counts:
        out.append(np.append(flat[ends[p] : ends[p + n]], np.uint32(end_id)))
        p += n
    return out


def schema(length: int = LENGTH) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(WIDTH, length)), ("mask", pa.list_(pa.bool_(), length))])


class Writer:
    """One shard: ids in, batches of ``SEQUENCES`` sequences out."""

    def __init__(self, sink, length: int = LENGTH) -> None:
        self.length, self.schema = length, schema(length)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.size = self.total = 0

    def add(self, ids: np.ndarray) -> int:
        start = self.total
        self.held.append(ids.astype(np.uint16))
        self.size += len(ids)
        self.total += len(ids)
        if self.size >= self.length * SEQUENCES:
            self.flush()
        return start

    def flush(self, last: bool = False) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint16)
        each = self.length * SEQUENCES
        full = len(ids) if last else len(ids) // each * each
        for i in range(0, full, each):
            part = ids[i : min(i + each, full)]
            rows = -(-len(part) // self.length)
            padded = np.zeros(rows * self.length, np.uint16)
            padded[: len(part)] = part
            mask = np.arange(rows * self.length) < len(part)
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(padded, WIDTH), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)]
            self.file.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.held, self.size = [ids[full:]], len(ids) - full

    def close(self) -> None:
        self.flush(last=True)
        self.file.close()


class Reader:
    """Random access by place in a shard; a local file is memory-mapped."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("input_ids").type.list_size
        self.at, self.batch = -1, None

    def sequences(self, k: int) -> np.ndarray:
        """The ids of batch k, one after the other."""
        if k != self.at:
            self.at, self.batch = k, self.file.get_batch(k)
        return self.batch.column(0).flatten().to_numpy(zero_copy_only=True)

    def read(self, start: int, n: int) -> np.ndarray:
        each, out = self.length * SEQUENCES, []
        for k in range(start // each, (start + n - 1) // each + 1):
            ids = self.sequences(k)
            out.append(ids[max(0, start - k * each) : start + n - k * each])
        return np.concatenate(out)

    def close(self) -> None:
        self.batch = None
        self.source.close()


PLACES = "doc_id long, shard string, at long, n_tokens long"


def write(docs: DataFrame, tokenizer: str, folder: str, shards: int, length: int = LENGTH) -> DataFrame:
    """Write the files to ``folder`` (a URI) and return the index (PLACES)."""

    def save(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        task, writer, cache = TaskContext.get(), None, opened(tokenizer)
        name = f"shard-{task.partitionId():06d}.arrow"
        temporary = f"{path}/.{name}.{task.taskAttemptId()}"
        for b in batches:
            if writer is None and b.num_rows:
                fs.create_dir(path, recursive=True)
                sink = fs.open_output_stream(temporary)
                writer = Writer(sink, length)
            ids = encode_many(cache, b.column(1).to_pylist())
            starts = [writer.add(x) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * len(ids), pa.string()), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64())], schema=fields(PLACES))
        if writer is not None:
            writer.close()
            sink.close()
            fs.move(temporary, f"{path}/{name}")
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    # Written once: reading the index again must not write the files again.
    return materialize(dealt.mapInArrow(save, PLACES), "places")[0]


def read_back(places: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    # One row for each shard; their number is a parameter of the writer.
    totals = places.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def check(batches):
        reader, name = None, None
        for b in batches:
            rows = []
            for doc, shard, at, n, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard != name:
                    if reader:
                        reader.close()
                    reader, name = Reader(f"{folder}/{shard}"), shard
                ids = reader.read(at, n)
                rows.append((doc, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), fields(out), strict=True)], schema=fields(out)) if rows else pa.RecordBatch.from_pylist([], schema=fields(out))

    return places.join(F.broadcast(before), "shard").select("doc_id", "shard", "at", "n_tokens", "base").mapInArrow(check, out)


def query(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all of docs, read the files back and digest what they hold."""
    spark = docs.sparkSession
    tune(spark)
    folder = fresh_path(spark, "token-files")
    # The planner's estimate of the input, from file sizes.
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES if size < 1 << 60 else 1)
    return read_back(write(docs, tokenizer, folder, shards), folder)
