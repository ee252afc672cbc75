"""Token ids in binary shards: one zstandard dictionary for all, each document compressed on its own, an offset index for short-document access.

A shard is one binary value: the magic, the SHA-256 of the dictionary, the number of documents n, n + 1 little-endian
64-bit frame offsets, n 32-bit token counts, then the frames (ids as little-endian unsigned 32-bit integers). `Shard`
opens one and reads single documents without decompressing others; it refuses a dictionary with another hash. Spark's own
writers store shards (rows of Parquet: partition, shard number, first token within the partition, least and greatest
document id, document ids, bytes) and, beside them, the dictionary, so any shared store works and a path is all that a
reader needs; documents are in ascending id order over partitions and shards.

The dictionary is fitted on a bounded sample (whole documents of lowest id hash: `SAMPLE` of them, and no more than
`SAMPLE_BYTES` in all); everything else covers all rows. A null text counts as empty: only the end id. Null ids come first; rows with equal ids keep their
own entries, in input order among them; an empty table gives no shards. Other columns aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .arrays import buffer_of
from .chunks import ChunkIds
from .common import partitions, scratch, slices, small_batches, stored

MAGIC = b"VLTOK1\0\0"
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 1500, 16 << 20, 1 << 16
SHARD_BYTES, PIECE = 4 << 20, 1 << 20
CHUNKS = 2_000_000
SHARDS = "part int, shard int, first long, least {id}, most {id}, doc_ids binary, n_docs long, n_tokens long, data binary"


class Encoder:
    """The tokenizers library on distinct chunks; a chunk's ids don't depend on its neighbours (`chunks`)."""

    def __init__(self, name: str, end_id: int):
        self.of = Tokenizer.from_file(public_tokenizers.path(name) if "/" not in name else name)
        added = [t.content for t in self.of.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.end = np.array([end_id], dtype="<u4")
        (self.newline,) = self.of.encode("\n", add_special_tokens=False).ids
        self.known = ChunkIds(self._learnt, CHUNKS)

    def _learnt(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes new chunks in one call: a newline between two of them is a piece, and so an id, of its own."""
        texts = [c.decode() for c in chunks]
        spaces = {n: self.of.encode(t, add_special_tokens=False).ids for n, t in enumerate(texts) if t.isspace()}
        plain = [t for n, t in enumerate(texts) if n not in spaces]
        lengths, ids = np.zeros(len(texts), dtype=np.int64), np.zeros(0, dtype=np.uint32)
        if plain:
            ids = np.array(self.of.encode_batch_fast(["\n".join(plain)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            cuts = np.append(np.flatnonzero(ids == self.newline), len(ids))
            if len(cuts) != len(plain):
                raise ValueError("chunks and ids don't match")
            lengths[[n for n in range(len(texts)) if n not in spaces]] = np.diff(cuts, prepend=-1) - 1
            ids = ids[ids != self.newline]
        if spaces:
            where = (np.cumsum(lengths) - lengths)[list(spaces)]
            ids = np.insert(ids, np.repeat(where, [len(x) for x in spaces.values()]), [i for x in spaces.values() for i in x])
            lengths[list(spaces)] = [len(x) for x in spaces.values()]
        return lengths, ids

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids as little-endian 32-bit integers, with the end id; null counts as empty."""
        whole = {}
        if self.added:  # these are found in whole texts
            marked = pc.fill_null(pc.match_substring_regex(texts, self.added.pattern), False)
            whole = {i: self.of.encode(texts[i].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(np.asarray(marked)).tolist()}
        ids, upto = self.known.ids(*buffer_of(texts))
        raw, end, cuts = ids.astype("<u4").tobytes(), self.end.tobytes(), (4 * upto).tolist()
        return [(np.array(whole[i], dtype="<u4").tobytes() if i in whole else raw[a:b]) + end for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(name: str, end_id: int) -> Encoder:
    if (name, end_id) not in _encoders:
        _encoders[name, end_id] = Encoder(name, end_id)
    return _encoders[name, end_id]


def build(frames: list[bytes], counts: list[int], digest: bytes) -> bytes:
    offsets = np.zeros(len(frames) + 1, dtype="<u8")
    np.cumsum([len(f) for f in frames], out=offsets[1:], dtype=np.uint64)
    return MAGIC + digest + struct.pack("<Q", len(frames)) + offsets.tobytes() + np.array(counts, dtype="<u4").tobytes() + b"".join(frames)


class Shard:
    def __init__(self, data: bytes, dictionary: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token shard")
        if data[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        (self.n,) = struct.unpack_from("<Q", data, 40)
        self.data = memoryview(data)
        self.offsets = np.frombuffer(data, "<u8", self.n + 1, 48)
        self.counts = np.frombuffer(data, "<u4", self.n, 56 + 8 * self.n)
        self.base = 56 + 12 * self.n
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def document(self, i: int) -> bytes:
        a, b = self.base + int(self.offsets[i]), self.base + int(self.offsets[i + 1])
        raw = self.reader.decompress(self.data[a:b])
        if len(raw) != 4 * int(self.counts[i]):
            raise ValueError(f"document {i} has {len(raw)} bytes; its count is {self.counts[i]}")
        return raw


def fitted_dictionary(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> bytes:
    """At most DICTIONARY_BYTES; empty where the sample is too small to train on. Of rows that share an id the one of least length, then text hash, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, end_id)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(e.encode_all(batch.column(0)), pa.binary())], names=["ids"])

    ids = docs.select(F.col(doc_id).alias("i")).where("i is not null").distinct().orderBy(F.xxhash64("i"), "i").limit(SAMPLE)
    named = docs.select(F.col(doc_id).alias("i"), F.coalesce(text, F.lit("")).alias("t")).join(F.broadcast(ids), "i")
    least = F.min(F.struct(F.octet_length("t").alias("n"), F.xxhash64("t").alias("h"), "t")).alias("x")
    sample = stored(named.groupBy("i").agg(least).select(F.xxhash64("i").alias("h"), "i", "x.n", "x.t"), "sample")
    chosen, total = [], 0
    for r in sorted(sample.select("h", "i", "n").collect(), key=lambda r: (r.h, r.i)):
        if total + r.n <= SAMPLE_BYTES:
            chosen.append(r.i)
            total += r.n
    found = [bytes(r.ids) for r in sample.where(F.col("i").isin(chosen)).select("t").mapInArrow(run, "ids binary").collect()]
    found.sort()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_shards(docs: DataFrame, path: str, dictionary: bytes, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the shards, by ranges of document ids, and the dictionary under `path`."""
    spark = docs.sparkSession
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    digest = hashlib.sha256(dictionary).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, first, total, held = TaskContext.get().partitionId(), 0, 0, 0, 0
        e = encoder(tokenizer, end_id)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=3)
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=shared)
        ids: list = []
        frames: list[bytes] = []
        counts: list[int] = []
        kind = None

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", kind)])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, kind)], names=["doc_id"]))
            known = [i for i in ids if i is not None]
            values = [part, shard, first, known[0] if known else None, known[-1] if known else None, sink.getvalue().to_pybytes(), len(ids), sum(counts), build(frames, counts, digest)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), kind, kind, pa.binary(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=["part", "shard", "first", "least", "most", "doc_ids", "n_docs", "n_tokens", "data"])

        for batch in batches:
            kind = batch.column(0).type
            for piece in slices(batch, 1, PIECE):
                for i, raw in zip(piece.column(0).to_pylist(), e.encode_all(piece.column(1))):
                    ids.append(i)
                    counts.append(len(raw) // 4)
                    frames.append(squeeze.compress(raw))
                    total += counts[-1]
                    held += len(frames[-1])
                    if held >= SHARD_BYTES:
                        yield row()
                        shard, first, held = shard + 1, total, 0
                        ids, frames, counts = [], [], []
        if ids:
            yield row()

    small_batches(spark)
    n = partitions(spark)
    # rows that share an id are told apart by their place, so that many of them are no one task's; range sampling then reads no texts
    placed = docs.select(doc_id, text, F.monotonically_increasing_id().alias("place_"))
    order = (F.col(doc_id).asc_nulls_first(), F.col("place_").asc())
    placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select(doc_id, text).mapInArrow(run, SHARDS.format(id=docs.schema[doc_id].dataType.simpleString())).write.parquet(f"{path}/shards")


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    return spark.read.parquet(f"{path}/shards"), bytes(spark.read.parquet(f"{path}/dictionary").first().data)


def _ids(blob: bytes) -> pa.Array:
    return pa.ipc.open_stream(blob).read_all().column(0).combine_chunks()


def documents(spark: SparkSession, path: str, wanted: list) -> DataFrame:
    """doc_id, ids of the documents of these ids: only shards whose range holds one are read, and only those frames decompressed."""
    shards, dictionary = _opened(spark, path)
    kind = shards.schema["least"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, data in zip(batch.column(0), batch.column(1)):
                ids = _ids(blob.as_py())
                at = np.flatnonzero(np.asarray(pc.is_in(ids, pa.array(wanted, ids.type))))
                shard = Shard(data.as_py(), dictionary)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([np.frombuffer(shard.document(i), "<u4").astype(np.int64) for i in at.tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    near = functools.reduce(lambda a, b: a | b, [F.lit(w).between(F.col("least"), F.col("most")) for w in wanted], F.lit(False))
    return shards.where(near).select("doc_ids", "data").mapInArrow(run, f"doc_id {kind}, ids array<long>")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards, dictionary = _opened(spark, path)
    # one row for each partition of the writer: as many as its setting says, however large the corpus
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    before, at = {}, 0
    for r in sorted(totals, key=lambda r: r.part):
        before[r.part] = at
        at += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, first, ids, data = (batch.column(j)[k].as_py() for j in range(4))
                shard = Shard(data, dictionary)
                ids = _ids(ids)
                ends = np.cumsum(shard.counts, dtype=np.int64)
                crcs = [zlib.crc32(shard.document(i)) for i in range(shard.n)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(before[part] + first + ends - shard.counts, pa.int64()), pa.array(shard.counts.astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "first", "doc_ids", "data").mapInArrow(run, f"doc_id {shards.schema['least'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dictionary = fitted_dictionary(docs, "byte_bpe_50k.json", 0)
    path = scratch(spark, "shards")
    write_shards(docs, path, dictionary)
    return read_shards(spark, path)
