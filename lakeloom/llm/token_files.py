"""Token ids in bit-plane shuffled files.

Documents are range-partitioned by id; each partition becomes one shard, a
stream of ids in document order cut into blocks of a fixed number of ids. A
block's ids are transposed into 32 bit planes or 4 byte planes and each plane
is compressed with zstandard. A block's row is its entry in the chunk index:
shard, block number, first position, count, and the documents it holds, beside
the compressed planes. Rows are Parquet, written by Spark's committer, so any
shared store serves and lost executors lose nothing. Only (shard, n_ids) of
the index is needed to turn positions in a shard into positions in the corpus.

Null text counts as empty (an end id alone). Rows of equal ids stay separate
documents, ordered by text; a null id comes first. A text of any length is
encoded whole and may span blocks. Only the id and the text are read, so other
columns may have any name. An empty table writes no block and reads back empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import OncePerTask, OncePerWorker, bound_batches, pieces_by_size, stored, text_of, trimmed
from .tokens import Encoder

#: Ids in a full block.
BLOCK_IDS = 1 << 18
#: Bytes of text encoded at once.
ENCODE_BYTES = 1 << 22
ZSTD_LEVEL = 1
#: Encoded pieces that a worker keeps, under 100 bytes each; this step's workers hold little else.
KEPT_PIECES = 800_000
END_ID = 0

BLOCK_SCHEMA = (
    "shard int, block int, first long, n_ids int, planes array<binary>, "
    "docs array<struct<doc_id: {id}, row: long, at: int, n: int, opens: boolean, closes: boolean>>"
)


def to_planes(ids: np.ndarray, bits: bool = False, level: int = ZSTD_LEVEL) -> list[bytes]:
    """The compressed byte planes (or bit planes) of 32-bit ids, most significant first."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    rows = ids.astype(">u4").view(np.uint8).reshape(-1, 4).T
    if not bits:
        return [squeeze(np.ascontiguousarray(r).tobytes()) for r in rows]
    return [squeeze(np.packbits(r >> k & 1).tobytes()) for r in rows for k in range(7, -1, -1)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The n ids of compressed planes."""
    expand = zstandard.ZstdDecompressor().decompress
    if len(planes) == 4:
        raw = [np.frombuffer(expand(p), np.uint8) for p in planes]
    else:
        bit = [np.unpackbits(np.frombuffer(expand(p), np.uint8), count=n) for p in planes]
        raw = [np.packbits(np.stack(bit[k : k + 8]), axis=0)[0] for k in range(0, 32, 8)]
    return np.ascontiguousarray(np.stack(raw, 1)).view(">u4").ravel().astype("<u4")


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, bits: bool = False) -> None:
    """Encode every whole text, append end_id, and write ids in ascending doc_id order to path."""
    df = docs.select(F.col(doc_id).alias("doc_id"), text_of(text))
    # Only ids are sampled for the ranges; texts move once.
    ordered = df.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    id_type = df.schema["doc_id"].dataType.simpleString()
    encoder = OncePerWorker(f"encoder {tokenizer} {KEPT_PIECES}", lambda: Encoder(tokenizer, KEPT_PIECES))
    end = np.array([end_id], np.uint32)
    schema = BLOCK_SCHEMA.format(id=id_type)
    arrow = DataFrameSchema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first, row = TaskContext.get().partitionId(), 0, 0, 0
        held, n_held = [], 0
        # The block's entries, a list for each field of docs.
        entries: list[list] = [[] for _ in range(6)]

        def full() -> pa.RecordBatch:
            fields = arrow().field("docs").type.value_type
            docs = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(entries, fields, strict=True)], fields=list(fields))
            columns = [pa.array([v], f.type) for v, f in zip((shard, block, first, n_held, to_planes(np.concatenate(held), bits)), arrow(), strict=False)]
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs, type=arrow().field("docs").type)], schema=arrow())

        for batch in batches:
            for piece in pieces_by_size(batch, "text", ENCODE_BYTES):
                for key, ids in zip(piece.column("doc_id").to_pylist(), encoder().encode(piece.column("text").to_pylist()), strict=True):
                    done, n = 0, len(ids) + 1
                    while done < n:
                        take = min(n - done, block_ids - n_held)
                        held.append(ids[done : done + take])
                        if done + take == n:
                            held.append(end)
                        for x, v in zip(entries, (key, row, n_held, take, done == 0, done + take == n), strict=True):
                            x.append(v)
                        done, n_held = done + take, n_held + take
                        if n_held == block_ids:
                            yield full()
                            block, first, held, n_held, entries = block + 1, first + n_held, [], 0, [[] for _ in range(6)]
                    row += 1
        if n_held:
            yield full()

    bound_batches(docs.sparkSession)
    ordered.mapInArrow(trimmed(run), schema).write.option("compression", "uncompressed").parquet(path)


class DataFrameSchema(OncePerTask):
    """The Arrow schema of a DDL string, known on workers too."""

    def __init__(self, ddl: str):
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = to_arrow_schema(StructType.fromDDL(ddl))
        super().__init__(lambda: schema)


def _crc_shift(crc: int, n_bytes: int) -> int:
    """The crc32 register after n_bytes zero bytes, by squaring the step's matrix over GF(2)."""

    def times(matrix: list[int], vector: int) -> int:
        out = 0
        for column in matrix:
            if vector & 1:
                out ^= column
            vector >>= 1
        return out

    step = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit, reflected polynomial
    n = 8 * n_bytes
    while n:
        if n & 1:
            crc = times(step, crc)
        step = [times(step, c) for c in step]
        n >>= 1
    return crc


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """The crc32 of byte strings in a row, from each one's (crc32, length)."""
    out = 0
    for crc, n in parts:
        out = _crc_shift(out, n) ^ crc
    return out


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files at path."""
    blocks = spark.read.parquet(path)
    id_type = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, first, n, planes = (batch.column(c)[i].as_py() for c in ("shard", "first", "n_ids", "planes"))
                docs = batch.column("docs")[i].values
                data = memoryview(from_planes(planes, n).tobytes())
                at, count = docs.field("at").to_numpy().astype(np.int64), docs.field("n").to_numpy().astype(np.int64)
                crc = [zlib.crc32(data[4 * a : 4 * (a + c)]) for a, c in zip(at.tolist(), count.tolist(), strict=True)]
                whole = pc.and_(docs.field("opens"), docs.field("closes"))
                columns = [pa.array(np.full(len(at), shard, np.int32)), docs.field("row"), docs.field("doc_id"), pa.array(first + at), pa.array(count), pa.array(crc, pa.int64()), whole]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "row", "doc_id", "at", "n", "crc", "whole"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = [crc32_joined([(p["crc"], 4 * p["n"]) for p in parts]) for parts in batch.column("p").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crcs, pa.int64())], names=[*batch.schema.names[:-1], "crc"])

    parts = blocks.select("shard", "first", "n_ids", "planes", "docs").mapInArrow(run, f"shard int, row long, doc_id {id_type}, at long, n long, crc long, whole boolean")
    # Blocks are decoded once; only rows of numbers go on. Documents that span blocks are joined from their parts.
    parts = stored(parts, "parts")
    split = parts.where("NOT whole").groupBy("shard", "row", "doc_id").agg(F.min("at").alias("at"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("p"))
    split = split.select("shard", "doc_id", "at", "n", "p").mapInArrow(joined, f"shard int, doc_id {id_type}, at long, n long, crc long")
    every = parts.where("whole").select("shard", "doc_id", "at", "n", "crc").unionByName(split)
    # The shards' sizes, from the index alone: one row for each write task, whose running sum is one small task.
    sizes = stored(blocks.groupBy(F.col("shard").alias("s")).agg(F.sum(F.col("n_ids").cast("long")).alias("ids")), "sizes")
    # Stored, so that Spark knows its size and broadcasts it only if small.
    before = stored(sizes.selectExpr("s", "sum(ids) OVER (ORDER BY s) - ids AS base"), "before")
    return every.join(before, F.col("shard") == F.col("s")).select("doc_id", (F.col("at") + F.col("base")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """shard, first and the ids of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (n, planes) in enumerate(zip(batch.column("n_ids").to_pylist(), batch.column("planes").to_pylist(), strict=True)):
                yield pa.RecordBatch.from_arrays([batch.column("shard").slice(i, 1), batch.column("first").slice(i, 1), pa.array([from_planes(planes, n)], pa.list_(pa.int64()))], names=["shard", "first", "ids"])

    return spark.read.parquet(path).select("shard", "first", "n_ids", "planes").mapInArrow(run, "shard int, first long, ids array<long>")
