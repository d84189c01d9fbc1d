"""Best-fit packing into bins of several permitted lengths.

Pieces are packed by best-fit decreasing over their length histogram, which a
length bound keeps small whatever the number of documents: bins with equal
contents are one class with a count, and a step places as many equal pieces as
fit. When no open bin fits, the bin size opened is the one of least cost per
token it is expected to hold, judged with all sizes and the pieces still to
come; at the end each bin shrinks to the smallest permitted size that holds
its contents. The plan (intervals of a length's ranks → bins) is bounded by
the lengths, not by the data; each piece finds its bin from its rank among
pieces of its length, so no task holds a length's pieces.

Documents longer than the largest size are cut: whole largest bins, then the
rest. Null or negative lengths count as zero; documents without tokens get a
row with no bin. Repeated rows are packed each. An empty table gives an empty
result. Which of equal pieces goes where follows from a hash of the keys.
"""

from __future__ import annotations

import bisect
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OncePerWorker, map_texts, pieces_by_size, stored, text_of
from .tokens import Encoder

#: Permitted sequence lengths.
SIZES = (1024, 2048, 4096)
#: Cost of a bin besides its length, in tokens.
OVERHEAD = 64
ENCODE_BYTES = 1 << 22
#: Parts that ranks within a length are counted in.
RANK_PARTS = 4096


class Bins(NamedTuple):
    """A class of bins with equal contents: count bins of size, holding pieces of these lengths in order."""

    count: int
    size: int
    lengths: tuple[int, ...]


def cost(size: int, overhead: int = OVERHEAD) -> int:
    return size + overhead


def plan(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> list[Bins]:
    """Classes of bins that hold histogram[n] pieces of each length n, in the order of their first opening."""
    sizes = tuple(sorted(sizes))
    # A class is a linked list of (length, previous): classes that split share their contents.
    open_bins: dict[int, list[list]] = {}  # room → [count, size, contents, first opening]
    rooms: list[int] = []
    lengths = sorted(histogram, reverse=True)
    left_tokens = sum(n * c for n, c in histogram.items())
    done: list[list] = []
    opened = 0

    def put(room: int, entry: list, smallest: int) -> None:
        if room < smallest:
            done.append(entry)
            return
        if room not in open_bins:
            bisect.insort(rooms, room)
            open_bins[room] = []
        open_bins[room].append(entry)

    smallest = lengths[-1] if lengths else 0
    for length in lengths:
        count = histogram[length]
        while count:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                entry = open_bins[room].pop(0)
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
                used = min(count, entry[0])
                if used < entry[0]:
                    put(room, [entry[0] - used, *entry[1:]], smallest)
                    entry[0] = used
                entry[2] = (length, entry[2])
                put(room - length, entry, smallest)
            else:
                size = least_cost_size(length, count, left_tokens, sizes, overhead)
                # Open as many as these pieces fill; more follow if the count calls for them.
                used = max(1, count // (size // length))
                put(size - length, [used, size, (length, None), opened], smallest)
                opened += 1
            count -= used
            left_tokens -= used * length
    out = []
    for entry in [*done, *(e for room in rooms for e in open_bins[room])]:
        held, node = [], entry[2]
        while node:
            held.append(node[0])
            node = node[1]
        total = sum(held)
        out.append((entry[3], Bins(entry[0], next(s for s in sizes if s >= total), tuple(reversed(held)))))
    out.sort(key=lambda x: (x[0], x[1]))
    return [b for _, b in out]


def least_cost_size(length: int, count: int, left_tokens: int, sizes: tuple[int, ...], overhead: int) -> int:
    """The size of least cost per token it is expected to hold.

    A bin of size s takes as many of the count equal pieces as fit; smaller
    pieces still to come fill the rest as far as their tokens reach.
    """
    smaller = left_tokens - length * count
    best = None
    for size in (s for s in sizes if s >= length):
        fit = min(size // length, count)
        bins = -(-count // fit)
        filled = fit * length + min(size - fit * length, smaller / bins)
        # After the end each bin shrinks to what it holds, so cost what remains.
        final = next(s for s in sizes if s >= min(filled, size))
        rate = cost(final, overhead) / filled
        if best is None or rate < best[0] - 1e-12:
            best = (rate, size)
    return best[1]


class Layout:
    """Where the k-th piece of a length goes."""

    def __init__(self, bins: list[Bins]):
        #: length → ([first rank of interval], [(first bin, step between ranks' bins, offset, size)])
        self.slots: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
        self.size: dict[int, int] = {}
        start = 0
        taken: dict[int, int] = {}
        for b in bins:
            at = 0
            for length in b.lengths:
                ranks, where = self.slots.setdefault(length, ([], []))
                ranks.append(taken.get(length, 0))
                where.append((start, at, b.size))
                taken[length] = taken.get(length, 0) + b.count
                at += length
            start += b.count
        self.bins = start

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bin, offset, size) of the pieces of this length with these ranks."""
        ranks, where = self.slots[length]
        ranks = np.array(ranks)
        k = np.searchsorted(ranks, rank, side="right") - 1
        start, at, size = np.array(where).T
        return start[k] + rank - ranks[k], at[k], size[k]


def token_lengths(docs: DataFrame, keys: list[str], text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """keys and n_tokens of every whole text."""
    encoder = OncePerWorker(f"encoder {tokenizer}", lambda: Encoder(tokenizer))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [len(ids) for p in pieces_by_size(batch, "text", ENCODE_BYTES) for ids in encoder().encode(p.column("text").to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*keys, "n_tokens"])

    df = docs.select(*keys, text_of(text))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return map_texts(df, work, f"{kept}, n_tokens long")


def pack(lengths: DataFrame, key: str = "doc_id", n: str = "n_tokens", sizes: tuple[int, ...] = SIZES, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, piece, start, n_tokens, bin, bin_offset and bin_size of each piece of each document."""
    top = max(sizes)
    rows = lengths.select(F.col(key).alias("doc_id"), F.greatest(F.coalesce(F.col(n), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    pieces = rows.select("doc_id", F.col("n").alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(n - 1) div {top}")))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top).cast("long"), F.col("whole") - F.col("piece") * top).alias("n_tokens"))
    # Ranks: parts of a length are counted, and a piece's rank is its part's start plus its rank there.
    parted = stored(pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_PARTS)).cast("int")), "pieces")
    counts = parted.groupBy("n_tokens").agg(F.count("*").alias("c"))
    # At most as many rows as the largest size, whatever the data.
    histogram = {r.n_tokens: r.c for r in counts.where("n_tokens > 0").toLocalIterator()}
    layout = Layout(plan(histogram, sizes, overhead))
    # Parts grow in number with the data only, so their ranks need no unbounded group.
    by_part = parted.where("n_tokens > 0").groupBy("n_tokens", "part").agg(F.count("*").alias("c"))
    starts = by_part.selectExpr("n_tokens AS l", "part AS p", "sum(c) OVER (PARTITION BY n_tokens ORDER BY part) - c AS base")
    ranked = parted.where("n_tokens > 0").selectExpr("*", "row_number() OVER (PARTITION BY n_tokens, part ORDER BY doc_id, piece) - 1 AS k")
    ranked = ranked.join(starts, (F.col("n_tokens") == F.col("l")) & (F.col("part") == F.col("p"))).select("doc_id", "piece", "start", "n_tokens", (F.col("base") + F.col("k")).alias("rank"))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = batch.column("n_tokens").to_numpy(), batch.column("rank").to_numpy()
        out = np.zeros((3, len(length)), np.int64)
        for value in np.unique(length):
            at = length == value
            out[:, at] = layout.place(int(value), rank[at])
        return pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(x) for x in out)], names=names)

    names = ["doc_id", "piece", "start", "n_tokens", "bin", "bin_offset", "bin_size"]
    key_type = ranked.schema["doc_id"].dataType.simpleString()
    placed = map_texts(ranked, place, f"doc_id {key_type}, piece long, start long, n_tokens long, bin long, bin_offset long, bin_size long")
    none = F.lit(None).cast("long")
    return placed.unionByName(parted.where("n_tokens = 0").select("doc_id", "piece", "start", "n_tokens", none.alias("bin"), none.alias("bin_offset"), none.alias("bin_size")))


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """pack() over the token lengths of docs."""
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return pack(token_lengths(keyed, ["doc_id"], tokenizer=tokenizer), sizes=sizes)
