"""Sampled SentencePiece segmentations: forward filtering, backward sampling.

A segmentation of a text is a path through the lattice of its pieces. No piece
of the vocabulary holds a space mark behind another character, so lattices
fall apart at words and the posterior over paths is the product of the words'.
Each distinct word, told apart by its bytes, is filtered forward once per
task: every position's sum over all paths that reach it. Each occurrence is then sampled backward, for
all occurrences of a block at once. The draws are a hash of (seed, row key,
position), so a row's segmentation doesn't depend on where it runs.

The vocabulary's scores are merge ranks, not likelihoods; a piece of rank r
weighs (r + 2) ** -alpha, after Zipf's law. A character without a piece, and a
literal space mark, is spelled in byte pieces, so decoding is lossless.

Null text counts as empty and has no pieces; repeated rows get equal pieces;
texts are handled whole, in time that grows with their length; a text without
spaces is one word. Only the id and the text are read, so other columns may
have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OncePerTask, map_texts, pieces_by_size, text_of
from .shingles import mix

SPACE_MARK = 0x2581
#: Stands for a space mark that was in the text.
LITERAL_MARK = 0x200000 | SPACE_MARK
BLOCK_BYTES = 1 << 21
#: Distinct words a task keeps filtered; beyond it starts anew.
CACHE_WORDS = 300_000
_P = np.uint64(0xD1342543DE82EF95)
_BYTE_EDGE = 1 << 30


def default_path() -> str:
    """The public 32k piece vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Trie:
    """The prefixes of all pieces as nodes, 0 the empty one; steps are looked up for many nodes at once, exactly."""

    def __init__(self, pieces: list[str]):
        steps: dict[int, int] = {}
        #: Node → the piece that ends there, or -1.
        self.ends = ends = [-1]
        for k, piece in enumerate(pieces):
            node = 0
            for c in piece:
                step = node << 22 | ord(c)
                if (after := steps.get(step)) is None:
                    after = steps[step] = len(ends)
                    ends.append(-1)
                node = after
            ends[node] = k
        self.ends = np.array(ends, np.int64)
        # A hash table with linear probing, at most a quarter full.
        self.bits = max(4, (4 * len(steps)).bit_length())
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        key, to = np.fromiter(steps.keys(), np.int64, len(steps)), np.fromiter(steps.values(), np.int64, len(steps))
        slot = self._slot(key)
        while len(key):
            _, first = np.unique(slot, return_index=True)
            first = first[self.key[slot[first]] < 0]
            self.key[slot[first]], self.to[slot[first]] = key[first], to[first]
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, to, slot = key[rest], to[rest], slot[rest] + 1 & (1 << self.bits) - 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _P >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The nodes behind these characters, -1 where no piece goes on."""
        key = node << 22 | codes
        slot = self._slot(key)
        found = self.key[slot]
        out = np.where(found == key, self.to[slot], -1)
        left = np.flatnonzero((found != key) & (found >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
            found = self.key[slot[left]]
            out[left] = np.where(found == key[left], self.to[slot[left]], -1)
            left = left[(found != key[left]) & (found >= 0)]
        return out


def _openings(space: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where words begin: at the first of spaces in a row, and where texts begin."""
    opens = space & ~np.concatenate([[False], space[:-1]])
    opens[begin] = True
    return np.flatnonzero(opens)


def _distinct_words(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """(for each word of the texts, in order, its number; the distinct words in the order of their first places)."""
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = _openings(np.frombuffer(data, np.uint8) == 32, (np.cumsum(sizes) - sizes)[sizes > 0])
    ends = np.concatenate([starts, [len(data)]]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


class Sampler:
    """The vocabulary and the filtered words; lives on a worker."""

    def __init__(self, path: str | None = None, alpha: float = 1.0, seed: int = 0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
        self.seed = np.uint64(int.from_bytes(hashlib.blake2b(str(seed).encode(), digest_size=8).digest(), "little"))
        n = model.get_piece_size()
        self.byte_id = np.zeros(256, np.int64)
        #: Bytes that each id decodes to.
        self.bytes_of: list[bytes] = [b""] * n
        rows = []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if chr(SPACE_MARK) in piece.lstrip(chr(SPACE_MARK)):
                    raise ValueError("a piece crosses words")
                self.bytes_of[i] = piece.replace(chr(SPACE_MARK), " ").encode()
                rows.append((i, piece, min(-model.get_score(i), n)))
        self.ids, self.longest = np.array([r[0] for r in rows], np.int64), max(len(r[1]) for r in rows)
        self.trie = _Trie([r[1] for r in rows])
        self.weight = -alpha * np.log(np.array([r[2] for r in rows]) + 2)
        self.byte_weight = -alpha * np.log(n + 2)
        self._forget()

    def _forget(self) -> None:
        self.word_no: dict[bytes, int] = {}
        self.base = np.zeros(0, np.int64)  # word → node of its first position, less one
        self.edge_at = np.zeros(1, np.int64)  # node → its first edge
        self.edge_cum, self.edge_len, self.edge_id = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _edges(self, codes: np.ndarray, word_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id, weight) of every piece in words' characters; word_end: each character's word's end."""
        n = len(codes)
        found = [[], [], [], []]
        spelled = np.ones(n, bool)
        at, node = np.arange(n), np.zeros(n, np.int64)
        for length in range(1, self.longest + 1):
            inside = at + length <= word_end[at]
            at, node = at[inside], node[inside]
            node = self.trie.step(node, codes[at + length - 1])
            on = node >= 0
            at, node = at[on], node[on]
            if not len(at):
                break
            k = self.trie.ends[node]
            hit = np.flatnonzero(k >= 0)
            k, start = k[hit], at[hit]
            if length == 1:
                spelled[start] = False
            for x, y in zip(found, (start, np.full(len(k), length), self.ids[k], self.weight[k]), strict=True):
                x.append(y)
        rest = np.flatnonzero(spelled)
        code = np.where(codes[rest] == LITERAL_MARK, SPACE_MARK, codes[rest])
        n_bytes = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        for x, y in zip(found, (rest, np.ones(len(rest), np.int64), _BYTE_EDGE + n_bytes, self.byte_weight * n_bytes), strict=True):
            x.append(y)
        return tuple(np.concatenate(x) for x in found)

    def _filter(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, words: list[bytes]) -> None:
        """Filter these new words forward and keep, for each position, its incoming edges' cumulative posterior."""
        flat = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        codes = codes[flat]
        ends = np.cumsum(lengths)
        first = np.repeat(ends - lengths, lengths)
        start, length, piece, weight = self._edges(codes, np.repeat(ends, lengths))
        node = start + length - 1  # an edge ends behind this character
        level = node - first[node]
        order = np.lexsort((node, level))
        start, length, piece, weight, node, level = (x[order] for x in (start, length, piece, weight, node, level))
        alpha, share = np.full(len(codes), -np.inf), np.zeros(len(node))
        bounds = np.searchsorted(level, np.arange(int(level[-1]) + 2))
        opens = start == first[start]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            value = weight[a:b] + np.where(opens[a:b], 0.0, alpha[start[a:b] - 1])
            cuts = np.flatnonzero(np.diff(node[a:b], prepend=-1))
            top = np.maximum.reduceat(value, cuts)
            size = np.diff([*cuts, b - a])
            mass = np.exp(value - np.repeat(top, size))
            total = np.add.reduceat(mass, cuts)
            alpha[node[a:b][cuts]] = top + np.log(total)
            share[a:b] = mass / np.repeat(total, size)
        order = np.argsort(node, kind="stable")
        share, node = share[order], node[order]
        count = np.bincount(node, minlength=len(codes))
        run = np.cumsum(share)
        cum = run - np.repeat(run[np.cumsum(count) - 1] - np.add.reduceat(share, np.cumsum(count) - count), count)
        cum[np.cumsum(count) - 1] = 2.0  # the last edge takes what rounding leaves
        n_nodes = len(self.edge_at) - 1
        self.word_no.update(zip(words, range(len(self.base), len(self.base) + len(words)), strict=True))
        self.base = np.concatenate([self.base, n_nodes + ends - lengths - 1])
        self.edge_at = np.concatenate([self.edge_at, self.edge_at[-1] + np.cumsum(count)])
        self.edge_cum = np.concatenate([self.edge_cum, cum])
        self.edge_len = np.concatenate([self.edge_len, length[order].astype(np.int32)])
        self.edge_id = np.concatenate([self.edge_id, piece[order].astype(np.int32)])

    def encode(self, texts: list[str], row_keys: np.ndarray) -> list[np.ndarray]:
        """A sampled segmentation of each text, as ids."""
        given = [(" " + t).encode() if t else b"" for t in texts]
        raw = [np.frombuffer(g.decode().encode("utf-32-le"), np.uint32) for g in given]
        sizes = np.array([len(r) for r in raw], np.int64)
        if not sizes.sum():
            return [np.zeros(0, np.int64) for _ in texts]
        codes = np.concatenate(raw).astype(np.int64)
        codes[codes == SPACE_MARK] = LITERAL_MARK
        codes[codes == 32] = SPACE_MARK
        begin = np.cumsum(sizes) - sizes
        starts = _openings(codes == SPACE_MARK, begin[sizes > 0])
        lengths = np.diff([*starts, len(codes)])
        which, listed = _distinct_words(given)
        sample = np.zeros(len(listed), np.int64)
        sample[which[::-1]] = np.arange(len(which))[::-1]
        if len(self.word_no) > CACHE_WORDS:
            self._forget()
        new = np.array([i for i, w in enumerate(listed) if w not in self.word_no], np.int64)
        if len(new):
            self._filter(codes, starts[sample[new]], lengths[sample[new]], [listed[i] for i in new.tolist()])
        word = np.fromiter(map(self.word_no.__getitem__, listed), np.int64, len(listed))[which]
        # Draws: a hash of seed, row key and position in the text.
        doc = np.repeat(np.arange(len(texts)), sizes)
        stream = mix(row_keys.astype(np.uint64) ^ self.seed)
        place, base = np.full(len(codes), -1, np.int64), self.base[word]
        left, at = lengths.copy(), starts
        while len(left):
            end = at + left - 1
            node = base + left
            d = doc[end]
            u = (mix(stream[d] + (end - begin[d]).astype(np.uint64) * _P) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.edge_at[node]
            short = np.flatnonzero(self.edge_cum[edge] <= u)
            while len(short):
                edge[short] += 1
                short = short[self.edge_cum[edge[short]] <= u[short]]
            place[end] = self.edge_id[edge]
            left = left - self.edge_len[edge]
            more = left > 0
            left, at, base = left[more], at[more], base[more]
        ends = np.flatnonzero(place >= 0)
        ids, owner = place[ends], doc[ends]
        spelled = np.flatnonzero(ids >= _BYTE_EDGE)
        if len(spelled):
            n_bytes = np.ones(len(ids), np.int64)
            n_bytes[spelled] = ids[spelled] - _BYTE_EDGE
            first = np.cumsum(n_bytes) - n_bytes
            ids, owner = np.repeat(ids, n_bytes), np.repeat(owner, n_bytes)
            text = np.where(codes[ends[spelled]] == LITERAL_MARK, SPACE_MARK, codes[ends[spelled]])
            letters = np.frombuffer("".join(map(chr, text.tolist())).encode(), np.uint8)
            slots = np.repeat(first[spelled] - (np.cumsum(n_bytes[spelled]) - n_bytes[spelled]), n_bytes[spelled]) + np.arange(n_bytes[spelled].sum())
            ids[slots] = self.byte_id[letters]
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def decode(self, ids) -> str:
        """The text that ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:]


def row_key(value) -> int:
    """A 64-bit key of a row's identifier."""
    return int.from_bytes(hashlib.blake2b(repr(value).encode(), digest_size=8).digest(), "little")


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """doc_id and ids (a sampled segmentation) of every row."""
    sampler = OncePerTask(lambda: Sampler(model, alpha, seed))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [i for p in pieces_by_size(batch, "text", BLOCK_BYTES) for i in sampler().encode(p.column(1).to_pylist(), np.array([row_key(k) for k in p.column(0).to_pylist()], np.uint64))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    df = docs.select(F.col(doc_id).alias("doc_id"), text_of(text))
    return map_texts(df, work, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids; null ids give an empty text."""
    sampler = OncePerTask(lambda: Sampler(model))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([sampler().decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    df = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    return map_texts(df, work, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (ids as little-endian unsigned 32-bit) and lossless (decoding gives the text back)."""
    sampler = OncePerTask(lambda: Sampler(model, alpha, seed))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for p in pieces_by_size(batch, "text", BLOCK_BYTES):
            texts = p.column(1).to_pylist()
            for t, ids in zip(texts, sampler().encode(texts, np.array([row_key(k) for k in p.column(0).to_pylist()], np.uint64)), strict=True):
                rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), sampler().decode(ids.tolist()) == t))
        n, crc, same = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], names=["doc_id", "n_pieces", "ids_crc32", "lossless"])

    df = docs.select(F.col(doc_id).alias("doc_id"), text_of(text))
    return map_texts(df, work, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids_crc32 long, lossless boolean")
