"""Jaccard self-join of word-shingle sets, exact, as connected components.

1. Routing. Two sets that reach the similarity differ in few tokens. Hash
   space is cut into more ranges than that, so at least one range holds the
   same tokens in both: every set is routed by (size class, range, digest of
   the range's tokens). A first pass finds the routes that two sets take; a
   map task ships each of its routes once, sorted and compressed, so a hot
   route is a row per task. A second pass gathers the sets on those routes,
   each with its size and a parity sketch, whose differing bits bound the
   differing tokens from below and keep apart sets that share a passage only.
   What the first pass found reaches the second as a filter sized from their
   number, or, beyond a bound, by a join on the route.
2. Subtrees. Components of what the sketches admit hold every similar pair.
   A group over a bound, of a route's sets or of a component's, is cut into
   chunks and linked in rounds: within each chunk, then between one set of each
   class found there, then between what is left outside the group's largest
   class and all its sets. Each set moves a few times, not once for each chunk,
   and no task grows with a group.
3. Signature trees. In each task nodes with OR-combined token bitmaps and size
   ranges are joined by dual traversal, which prunes node pairs by their
   greatest possible overlap; what is left is compared exactly.
4. Components of the links found, spread to the exact copies.

Null and empty texts, and texts without words, have no shingles and link with
nothing. Texts are shingled whole. Only the id and the text are read, so other
columns may have any name. Rows of one doc_id are one node of the graph and each a row of the
result. Null doc_ids link with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, free_name, pieces_by_size, stored, text_of, trimmed
from .components import components
from .shingles import mix, shingle_sets
from .signature_tree import Forest, link

#: Bytes of text handled at once.
BLOCK_BYTES = 1 << 21
#: Sets, and bytes of sets, of one side of a task.
CHUNK_SETS, CHUNK_BYTES = 512, 16 << 20
#: Least bits of the parity sketches that keep documents on one route apart.
LEAST_SKETCH_BITS = 512
#: Route keys of a part that is searched for repeats at once, and keys a map task gathers before it ships them.
PART_KEYS, SHIP_KEYS = 1 << 20, 1 << 19
#: Bits of the filter of routes for each of them, and most bits as a power of two (32 MB); beyond, routes are joined.
FILTER_SHARE, FILTER_MOST = 16, 28
#: Rows of small routes that share a task.
TASK_ROWS = 1 << 13
#: Most rows of a doc_id list that is broadcast, 16 bytes each; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def class_bounds(percent: int, most: int) -> np.ndarray:
    """Lower bounds of size classes; similar sets are at most one class apart."""
    bounds = [1]
    while bounds[-1] <= most:
        bounds.append(100 * bounds[-1] // percent + 1)
    return np.array(bounds, np.int64)


def routes(tokens: np.ndarray, percent: int, bounds: np.ndarray) -> np.ndarray:
    """The route keys of one sorted token set."""
    out, n = [], len(tokens)
    own = int(np.searchsorted(bounds, n, side="right")) - 1
    scrambled = mix(tokens)
    for group in (own, own + 1):
        # Sets of this group's pairs have at most top tokens; sets a and b differ in (a + b)(100 - p)/(100 + p) at most.
        top = int(bounds[group + 1]) - 1
        ranges = 2 * top * (100 - percent) // (100 + percent) + 3
        which = ((tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(which, prepend=-1))
        digest, held = np.add.reduceat(scrambled, cuts), which[cuts]
        # This set and a partner differ in `most` ranges at most, and agree on no more empty ones than it has:
        # of any most + empty + 1 ranges one is held alike. Both sides take the first ones.
        most = (n + min(top, 100 * n // percent)) * (100 - percent) // (100 + percent)
        first = most + ranges - len(held) + 1
        if first > ranges:
            empty = np.setdiff1d(np.arange(ranges), held, assume_unique=True)
            held, digest = np.concatenate([held, empty]), np.concatenate([digest, np.zeros(len(empty), np.uint64)])
        taken = held < first
        out.append(mix(digest[taken] + mix(np.uint64(group) << np.uint64(40) | held[taken].astype(np.uint64))))
    return np.concatenate(out).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], width: int, at: int = 1) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for piece in pieces_by_size(batch, "text", BLOCK_BYTES):
            if piece.num_rows:
                yield piece, shingle_sets([t.encode("utf-8", "surrogatepass") for t in piece.column(at).to_pylist()], width)


def _digest(tokens: np.ndarray) -> bytes | None:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def _routed(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    bounds = class_bounds(percent, 2 * max(map(len, sets), default=1))
    return [routes(s, percent, bounds) if len(s) else np.empty(0, np.int64) for s in sets]


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """Bits that say whether an odd number of tokens falls on them: two sketches differ in no more bits than sets in tokens.

    There are as many bits as tokens, rounded up to a power of two; the two
    halves of a sketch, folded by exclusive or, are the sketch of half the bits.
    """
    bits = max(LEAST_SKETCH_BITS, 1 << (len(tokens) - 1).bit_length()) if len(tokens) else LEAST_SKETCH_BITS
    return np.packbits((np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.uint64)


class Sketches:
    """Sketches of several lengths; sets on one route differ by one doubling at most."""

    def __init__(self, blobs: list[bytes]):
        self.length = np.array([len(b) for b in blobs], np.int64)
        self.table: dict[int, np.ndarray] = {}
        self.row: dict[int, np.ndarray] = {}
        for size in np.unique(self.length).tolist():
            own, double = np.flatnonzero(self.length == size), np.flatnonzero(self.length == 2 * size)
            rows = [np.frombuffer(b"".join([blobs[k] for k in own]), np.uint64).reshape(len(own), -1)]
            if len(double):
                long = np.frombuffer(b"".join([blobs[k] for k in double]), np.uint64).reshape(len(double), 2, -1)
                rows.append(long[:, 0] ^ long[:, 1])
            self.table[size] = np.concatenate(rows)
            self.row[size] = np.full(len(blobs), -1, np.int64)
            self.row[size][np.concatenate([own, double])] = np.arange(len(own) + len(double))

    def of(self, at: np.ndarray, size: int) -> np.ndarray:
        """The sketches at these places, folded to size bytes."""
        return self.table[size][self.row[size][at]]


def compatible(n_a, sketch_a, n_b, sketch_b, percent: int) -> np.ndarray:
    """False only where sizes or sketches show that sets can't reach the similarity; shapes broadcast."""
    differing = np.bitwise_count(sketch_a ^ sketch_b).sum(-1, dtype=np.int64)
    return (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & ((100 + percent) * differing <= (100 - percent) * (n_a + n_b))


def _connect(forest: Forest, members: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int, side: np.ndarray | None = None) -> None:
    """Join members of one route that compatible pairs connect; with side only pairs across sides count.

    Pairs connected already aren't compared: what stands outside the largest
    component is compared with everything.
    """
    root = forest.roots(members)
    known, at, size = np.unique(root, return_inverse=True, return_counts=True)
    if len(known) == 1:
        return
    apart = np.flatnonzero(at != size.argmax())
    for k in range(0, len(apart), 256):
        rows = apart[k : k + 256]
        fits = (root[rows, None] != root[None]) & compatible(n[rows, None], sketch[rows, None], n[None], sketch[None], percent)
        if side is not None:
            fits &= side[rows, None] != side[None]
        for i in np.flatnonzero(fits.any(1)).tolist():
            for other in np.unique(root[fits[i]]).tolist():
                forest.join(int(root[rows[i]]), other)


def _meetings(df: DataFrame, rows: DataFrame, firsts: DataFrame, width: int, percent: int) -> DataFrame:
    """src, dst: stars over documents that meet on a route and that sketches don't keep apart."""
    spark = df.sparkSession
    df = df.where("doc_id IS NOT NULL")
    total = rows.agg(F.sum("n_shingles").alias("n"), F.count("*").alias("c")).first()
    expected = 5 * (total.n or 0) * (100 - percent) // (100 + percent) + 8 * total.c
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-expected // PART_KEYS))

    def ship(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row for each part that keys fall into: sorted keys, and which of them came twice here."""
        keys, count = np.unique(keys.view(np.uint64), return_counts=True)
        part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        squeeze = zstandard.ZstdCompressor(level=1).compress
        step = np.diff(keys, prepend=np.uint64(0))
        blobs, twice = [], []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
            first = step[a:b].copy()
            first[0] = keys[a]
            blobs.append(squeeze(np.ascontiguousarray(first.view(np.uint8).reshape(-1, 8).T).tobytes()))
            twice.append(np.packbits(count[a:b] > 1).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int32()), pa.array(blobs, pa.binary()), pa.array(twice, pa.binary()), pa.array(np.diff([*cuts, len(keys)]), pa.int32())], names=["part", "keys", "twice", "n"])

    def keys_of(batches):
        held, n = [], 0
        for _, sets in _blocks(batches, width):
            held += _routed(sets, percent)
            n += sum(map(len, held[-len(sets) :]))
            if n >= SHIP_KEYS:
                yield from ship(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from ship(np.concatenate(held))

    def repeated(table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor().decompress
        seen, twice = [], []
        for blob, flags, n in zip(*(table.column(c).to_pylist() for c in ("keys", "twice", "n")), strict=True):
            keys = np.cumsum(np.ascontiguousarray(np.frombuffer(expand(blob), np.uint8).reshape(8, n).T).view(np.uint64).ravel(), dtype=np.uint64)
            seen.append(keys)
            twice.append(keys[np.unpackbits(np.frombuffer(flags, np.uint8), count=n).astype(bool)])
        keys, count = np.unique(np.concatenate(seen), return_counts=True)
        keys = np.union1d(keys[count > 1], np.concatenate(twice))
        return pa.table({"n": pa.array([len(keys)], pa.int64()), "keys": pa.array([keys.tobytes()], pa.binary())})

    found = stored(df.mapInArrow(trimmed(keys_of), "part int, keys binary, twice binary, n int").groupBy("part").applyInArrow(repeated, "n long, keys binary"), "repeated")
    n_keys = found.agg(F.sum("n")).first()[0] or 0
    filter_bits = max(16, (FILTER_SHARE * n_keys - 1).bit_length()) if n_keys else 16

    def slices(batches):
        # A part's keys are a stretch of hash space, so its bits are a stretch of the filter.
        for batch in batches:
            for blob in batch.column("keys").to_pylist():
                at = np.unique(np.frombuffer(blob, np.uint64) >> np.uint64(64 - filter_bits))
                if len(at):
                    first = int(at[0] >> np.uint64(3))
                    bits = np.zeros(int(at[-1] >> np.uint64(3)) - first + 1, np.uint8)
                    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64) - first, (1 << (at & np.uint64(7)).astype(np.int64)).astype(np.uint8))
                    yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["first", "bits"])

    def listed(batches):
        for batch in batches:
            for blob in batch.column("keys").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(blob, np.int64))], names=["k"])

    admitted = None
    if filter_bits <= FILTER_MOST:
        table = np.zeros(1 << (filter_bits - 3), np.uint8)
        for r in found.mapInArrow(slices, "first long, bits binary").toLocalIterator():
            table[r.first : r.first + len(r.bits)] |= np.frombuffer(r.bits, np.uint8)
        admitted = spark.sparkContext.broadcast(table.tobytes())
        del table

    def members(batches):
        bits = np.frombuffer(admitted.value, np.uint8) if admitted else None
        for piece, sets in _blocks(batches, width):
            taken = _routed(sets, percent)
            if bits is not None:
                at = [keys.view(np.uint64) >> np.uint64(64 - filter_bits) for keys in taken]
                taken = [keys[(bits[(a >> np.uint64(3)).astype(np.int64)] >> (a & np.uint64(7)).astype(np.uint8)) & 1 > 0] for keys, a in zip(taken, at, strict=True)]
            take = pa.array(np.repeat(np.arange(len(sets)), [len(k) for k in taken]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(taken)), piece.column(0).take(take), pa.array([_digest(s) for s in sets], pa.binary()).take(take)], names=["key", "doc_id", "digest"])

    # A doc_id can hold several sets: the tag says which of them takes the route.
    tag = F.xxhash64("digest").alias("tag")
    on_routes = df.mapInArrow(trimmed(members), "key long, doc_id long, digest binary").select("key", "doc_id", tag)
    if admitted is None:
        on_routes = on_routes.join(found.mapInArrow(listed, "k long"), F.col("key") == F.col("k"), "left_semi")
    on_routes = stored(on_routes, "routes")
    if admitted is not None:
        admitted.destroy()
    # Of routes with equal members one is enough: sums over members tell them apart, combined before they are shuffled.
    taken = on_routes.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.xxhash64("doc_id", "tag").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("doc_id", "tag", F.lit(1))).alias("x")).where("m > 1")
    one_each = stored(taken.groupBy("m", "s", "x").agg(F.min("key").alias("k")).select("k"), "kept")
    met = on_routes.join(one_each, F.col("key") == F.col("k"), "left_semi")
    # Copies are known from their digests: only a set's first document goes on.
    first = firsts.select(F.col("digest").alias("fd"), "first")
    described = rows.join(first, (F.col("digest") == F.col("fd")) & (F.col("doc_id") == F.col("first")), "left_semi").select(F.col("doc_id").alias("d"), tag.alias("t"), F.col("n_shingles").alias("n"), "sketch")
    met = stored(met.join(described, (F.col("doc_id") == F.col("d")) & (F.col("tag") == F.col("t"))).select("key", "doc_id", "n", "sketch"), "met")
    large = stored(met.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("m")).where(F.col("m") > CHUNK_SETS), "large")
    # Many small routes share a task; large ones are linked in rounds.
    tasks = max(1, -(-met.count() // TASK_ROWS))
    small = met.join(large, F.col("key") == F.col("k"), "left_anti").withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks)))

    def stars(table: pa.Table) -> pa.Table:
        key, ids, n = (table.column(c).to_numpy() for c in ("key", "doc_id", "n"))
        sketch = Sketches(table.column("sketch").to_pylist())
        # One forest for all routes here: what one has connected the next needn't compare.
        nodes, place = np.unique(ids, return_inverse=True)
        forest = Forest(len(nodes))
        order = np.lexsort((ids, key))
        new = np.diff(key[order], prepend=0) != 0
        new[:1] = True
        cuts = np.flatnonzero(new)
        size = np.diff([*cuts, len(order)])
        for g in sorted(np.flatnonzero(size > 2).tolist(), key=lambda g: -size[g]):
            some = order[cuts[g] : cuts[g] + size[g]]
            _connect(forest, place[some], n[some], sketch.of(some, int(sketch.length[some].min())), percent)
        # Routes of two at once.
        a, b = order[cuts[size == 2]], order[cuts[size == 2] + 1]
        shorter = np.minimum(sketch.length[a], sketch.length[b])
        for length in np.unique(shorter).tolist():
            x, y = a[shorter == length], b[shorter == length]
            fits = compatible(n[x], sketch.of(x, length), n[y], sketch.of(y, length), percent)
            for u, v in zip(place[x[fits]].tolist(), place[y[fits]].tolist(), strict=True):
                forest.join(u, v)
        roots = forest.flat()
        at = np.flatnonzero(roots != np.arange(len(nodes)))
        return pa.table({"src": nodes[roots[at]], "dst": nodes[at]})

    def meet(table: pa.Table, forest: Forest, side: np.ndarray | None) -> None:
        sketch = Sketches(table.column("sketch").to_pylist())
        everyone = np.arange(table.num_rows)
        _connect(forest, everyone, table.column("n").to_numpy(), sketch.of(everyone, int(sketch.length.min())), percent, side)

    out = small.groupBy("task").applyInArrow(stars, "src long, dst long").where("src <> dst")
    if not large.isEmpty():
        rows = met.join(large.select("k"), F.col("key") == F.col("k")).select(F.col("key").alias("g"), F.col("doc_id").alias("node"), F.octet_length("sketch").cast("long").alias("bytes"), "n", "sketch")
        out = out.union(_in_rounds(stored(rows, "crowds"), meet, ["n", "sketch"]))
    return out.distinct()


def _in_rounds(rows: DataFrame, kernel: Callable[[pa.Table, Forest, np.ndarray | None], None], payload: list[str]) -> DataFrame:
    """src, dst: links among the nodes of large groups.

    rows has g, node, bytes and payload. kernel joins, in the forest over a
    table's rows, those that link, across sides if there are any. Every pair of
    a group's nodes is compared in some task or known to be connected.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")  # smallest first, so that a root is its class's smallest
        ids, label, side = (table.column(c).to_numpy() for c in ("node", "label", "side"))
        forest = Forest(len(ids))
        _, first, at = np.unique(label, return_index=True, return_inverse=True)
        forest.parent[:] = first[at]
        kernel(table, forest, side if (side != side[0]).any() else None)
        roots = forest.flat()
        return pa.table({"g": table.column("g"), "src": ids[roots], "dst": ids})

    def linked(tasks: DataFrame, *key: str) -> DataFrame:
        return tasks.select("g", *key, "node", "label", "side", *payload).groupBy("g", *key).applyInArrow(run, "g long, src long, dst long")

    def parts(sized: DataFrame, name: str) -> DataFrame:
        """For each group the number of chunks that its rows fill."""
        filled = F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("bytes") / CHUNK_BYTES))
        return sized.groupBy("g").agg(filled.cast("int").alias(name))

    alone = F.lit(0).alias("side")
    rows = rows.join(parts(rows, "chunks"), "g").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    within = stored(linked(rows.select("*", F.col("node").alias("label"), alone), "chunk"), "within")

    heads = rows.join(within.select("g", F.col("src").alias("node")).distinct(), ["g", "node"], "left_semi")
    heads = stored(heads.select("g", "node", "bytes", *payload), "heads")
    heads = heads.join(parts(heads, "m"), "g").withColumn("c", F.pmod(F.xxhash64("node", F.lit(1)), F.col("m")).cast("int"))
    heads = heads.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    heads = heads.withColumns({"i": F.least("c", "other"), "j": F.greatest("c", "other"), "label": F.col("node")})
    between = linked(heads.withColumn("side", F.when(F.col("i") == F.col("j"), 0).otherwise((F.col("c") == F.col("j")).cast("int"))), "i", "j")
    known = stored(within.union(between).where("src <> dst").select("src", "dst").distinct(), "known")

    labels = components(known)
    state = rows.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    state = stored(state.select("g", "node", "bytes", "chunk", "chunks", "label", *payload), "state")
    largest = state.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("g").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
    outside = stored(state.join(largest, "g").where("label <> main").drop("main"), "outside")
    if outside.isEmpty():
        return known
    blocks = stored(parts(outside, "blocks"), "blocks")
    outside = outside.join(blocks, "g").withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
    outside = outside.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    inside = state.join(blocks, "g").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["g", "chunk", "block", "node", "label", *payload]
    tasks = outside.select(*columns, F.lit(0).alias("side")).unionByName(inside.select(*columns, F.lit(1).alias("side")))
    return known.union(linked(tasks, "chunk", "block").where("src <> dst").select("src", "dst"))


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs.

    Rows link when 100 * intersection >= percent * union of their sets of
    width-word shingles; component_id is the smallest doc_id reachable.
    """
    bound_batches(docs.sparkSession)
    df = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text))

    def describe(batches):
        for piece, sets in _blocks(batches, width):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array([parity_sketch(s).tobytes() for s in sets], pa.binary())], names=["doc_id", "n_shingles", "digest", "sketch"])

    rows = stored(df.mapInArrow(trimmed(describe), "doc_id long, n_shingles long, digest binary, sketch binary"), "sets")
    # Copies of a set: the smallest doc_id stands for them.
    firsts = stored(rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "firsts")

    pairs = stored(_meetings(df, rows, firsts, width, percent), "meets")
    copied = firsts.where("copies > 1").select(F.col("digest").alias("d"), "first")
    copies = rows.where("doc_id IS NOT NULL").join(copied, F.col("digest") == F.col("d")).where("doc_id <> first").select("first", "doc_id").distinct()
    # Copies need no comparison: only sets' first documents take part in the trees.
    nodes = components(pairs)
    members = stored(nodes.join(firsts.groupBy("first").agg(F.sum("n_shingles").alias("n")), nodes.node == F.col("first")).select("node", "component", "n"), "members")
    sizes = members.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")).where("sets > 1")
    large = (F.col("sets") > CHUNK_SETS) | (F.col("tokens") * 8 > CHUNK_BYTES)
    placed = members.join(sizes.select("component", large.alias("large")), "component").select(F.col("node").alias("first"), "component", "large")
    placed = stored(placed, "placed")
    few = placed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = df.join(F.broadcast(placed) if few else placed, df.doc_id == placed["first"]).select("doc_id", "text", "component", "large")
    if not rows.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        texts = texts.dropDuplicates(["doc_id", "text"])

    def collect_sets(batches):
        for piece, sets in _blocks(batches, width):
            held = [i for i, s in enumerate(sets) if len(s)]
            kept = piece.take(pa.array(held, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), *kept.columns[2:], pa.array([sets[i].tobytes() for i in held], pa.binary())], names=["node", "g", "large", "tokens"])

    sets = texts.mapInArrow(trimmed(collect_sets), "node long, g long, large boolean, tokens binary")
    crowded = not placed.where("large").isEmpty()
    if crowded:
        sets = stored(sets, "tokens")

    def join_trees(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("node")  # smallest first, so that a root is its component's smallest
        ids, forest = table.column("node").to_numpy(), Forest(table.num_rows)
        tree_kernel(table, forest, None)
        return pa.table({"src": ids[forest.flat()], "dst": ids})

    def tree_kernel(table: pa.Table, forest: Forest, side: np.ndarray | None) -> None:
        link([np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()], percent, side, forest)

    links = sets.where("NOT large").groupBy("g").applyInArrow(join_trees, "src long, dst long").where("src <> dst")
    if crowded:
        crowds = sets.where("large").select("g", "node", F.octet_length("tokens").cast("long").alias("bytes"), "tokens")
        links = links.union(_in_rounds(crowds, tree_kernel, ["tokens"]))
    labels = components(links.union(copies))
    return (
        rows.join(labels, rows.doc_id == labels.node, "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component of similar documents: the one of the smallest doc_id.

    All columns stay as they were, whatever their names. Rows of one doc_id
    stay or go together; rows of a null doc_id or without words stay.
    """
    found = jaccard_components(docs, width, percent, doc_id, text)
    name = free_name(docs, "gone")
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, docs[doc_id] == F.col(name), "left_anti")
