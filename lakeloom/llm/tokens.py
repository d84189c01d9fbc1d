"""Encoding with a byte-level BPE of the tokenizers library, with words encoded once.

A byte-level BPE of this family always starts a token at a single space that
stands between two characters that aren't white space. Texts are cut at those
spaces in Arrow, and a piece that ends in marks behind a letter is cut there
too. Each distinct part is encoded by the library once for as long as it is
kept, and the ids of a text are its parts' ids in order, gathered from one
array. Parts are kept and found as Arrow arrays: known ones stand before a
batch's own in one dictionary, so no Python string is made for them.
Texts with other runs of white space around spaces are encoded whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Encoded pieces that a worker keeps unless it is told otherwise, and ids for each; beyond either the half that wasn't used for longest goes.
CACHE_PIECES, IDS_PER_PIECE = 500_000, 8
#: Longest piece that is kept.
CACHE_CHARS = 64
#: Pieces that are encoded in one text.
JOINED_PIECES = 500
#: Pieces whose ids are gathered at once, one text at least.
GATHERED_PIECES = 1 << 20
#: Marks that make a token of their own, or several, behind a letter at a piece's end; none can begin a special token's end.
_MARKS = ".,:;!?)]}$&#*%\""
_ASCII_LETTERS = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
#: Bytes of letters of long standing, which every version of Unicode takes for letters: A-Z, a-z, U+00C0 to U+027F but two signs.
_LETTER_BYTES = _ASCII_LETTERS | (np.arange(256) >= 0x80) & (np.arange(256) < 0xC0) | (np.arange(256) >= 0xC3) & (np.arange(256) < 0xCA)
#: Bytes that white space, or the character that marks cuts, can hold but for those behind a first byte.
_ODD_BYTES = (np.arange(256) <= 0x20) | (np.arange(256) == 0xC2) | (np.arange(256) >= 0xE0)
#: A space with white space beside it: cutting there could split a token.
_UNSAFE = re.compile(r" [\s\x1c-\x1f\x85]|[\s\x1c-\x1f\x85] ")


#: White space but space and line feed, and the character that marks cuts.
_RARES = [c for c in map(chr, range(0x3001)) if c not in " \n" and (c.isspace() or c in "\0\x1c\x1d\x1e\x1f\x85")]


def _marked(text: str) -> str | None:
    """text with spaces where it may be cut and \\0 before pieces without a space of their own; None if it can't be cut.

    A single line feed between characters that aren't white space is a token
    of its own, so pieces end there too.
    """
    if "  " in text or " \n" in text or "\n " in text:
        return None
    if any(map(text.__contains__, _RARES)):
        return None if "\0" in text or _UNSAFE.search(text) else "\0" + text
    if "\n" in text and not ("\n\n" in text or text[0] == "\n" or text[-1] == "\n"):
        text = text.replace("\n", " \0\n \0")
    return "\0" + text


def default_path() -> str:
    """The public 50k byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Ragged:
    """A growing list of id lists in one array."""

    def __init__(self):
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.length, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def extend(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Append lists that lie behind one another in ids."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(lengths) > len(self.at):
            self.at, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.length))
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.length[self.n : self.n + len(lengths)] = lengths
        self.used, self.n = self.used + len(ids), self.n + len(lengths)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these lists in a row, the lists' lengths)."""
        lengths = self.length[which]
        ends = np.cumsum(lengths, dtype=np.int64)
        place = np.repeat(self.at[which] - (ends - lengths), lengths)
        place += np.arange(len(place))
        return self.ids[place], lengths


def _bytes(strings: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes that strings lie in, where each begins and the last one ends)."""
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1] if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8), offsets


def _count(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set between each offset and the next."""
    return np.diff(np.concatenate([[0], np.cumsum(flags[offsets[0] : offsets[-1]], dtype=np.int64)])[offsets - offsets[0]])


def _signs(data: np.ndarray) -> np.ndarray:
    """Where the two signs among the letters' code points (U+00D7, U+00F7) begin."""
    found = data == 0xC3
    found[:-1] &= (data[1:] == 0x97) | (data[1:] == 0xB7)
    return found


class Encoder:
    """Texts to unsigned 32-bit ids; lives on a worker."""

    def __init__(self, path: str | None = None, keep: int | None = None):
        self.keep = CACHE_PIECES if keep is None else keep
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path or default_path())
        kind = str(self.tokenizer.pre_tokenizer)
        if "ByteLevel" not in kind or self.tokenizer.normalizer is not None:
            raise ValueError("only byte-level BPE vocabularies without a normalizer can be encoded by pieces")
        #: The same model for words of letters, each one match of the usual pattern, which is then not needed; None if they may be split.
        self.quick = None
        added = (t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        if kind.startswith("ByteLevel(") and "use_regex=True" in kind and all(re.search(r"[^\w\s]", t) for t in added):
            self.quick = Tokenizer(self.tokenizer.model)
            self.quick.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes of text that each id stands for.
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.id_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        #: Pieces by their numbers; the numbers' ids, and the block each was last used in.
        self.known = pa.array([], pa.large_string())
        self.held, self.last, self.block = _Ragged(), np.zeros(1 << 14, np.int32), 0

    def _whole(self, text: str, by=None) -> np.ndarray:
        return np.array((by or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, pieces: pa.LargeStringArray) -> None:
        """Encode new pieces, which get the next numbers."""
        data, offsets = _bytes(pieces)
        bare = np.zeros(len(pieces), bool)
        filled = offsets[:-1] < offsets[1:]
        bare[filled] = data[offsets[:-1][filled]] == 0
        # Pieces without white space are encoded in one text, behind spaces or line feeds, and told apart by their bytes.
        alone = (_count(_ODD_BYTES[data], offsets) > bare) | (np.diff(offsets) == bare)
        for k in np.flatnonzero(alone).tolist():
            p = pieces[k].as_py()
            alone[k] = p in ("", "\0") or len(p.split()) != 1 or p[-1].isspace() or p[1:2].isspace()
        letters = ~(alone | bare) & (_count(~_LETTER_BYTES[data] | _signs(data), offsets) == 0) & (self.quick is not None)
        groups = [(letters, " ", self.quick), (~(letters | alone | bare), " ", self.tokenizer), (bare & ~alone, "\n", self.tokenizer)]
        found = [(which, *self._joined(pieces.take(pa.array(which)), gap, by)) for group, gap, by in groups if len(which := np.flatnonzero(group))]
        if len(which := np.flatnonzero(alone)):
            ids = [self._whole(p[1:] if p[:1] == "\0" else " " + p) for p in pieces.take(pa.array(which)).to_pylist()]
            found.append((which, np.concatenate(ids), np.array([len(x) for x in ids], np.int64)))
        if found:
            order, ids, lengths = map(np.concatenate, zip(*found, strict=True))
            grouped = _Ragged()
            grouped.extend(ids, lengths)
            self.held.extend(*grouped.take(np.argsort(order)))

    def _joined(self, pieces: pa.LargeStringArray, gap: str, by) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of pieces encoded with a gap before each: a space is part of the piece's first token, a line feed a token of its own."""
        if gap == "\n":
            pieces = pc.utf8_slice_codeunits(pieces, 1)
        sizes, found = pc.binary_length(pieces).to_numpy() + 1, []
        for at in range(0, len(pieces), JOINED_PIECES):
            ids = self._whole(gap + gap.join(pieces.slice(at, JOINED_PIECES).to_pylist()), by)
            ends = np.cumsum(sizes[at : at + JOINED_PIECES])
            cuts = np.searchsorted(have := np.cumsum(self.id_bytes[ids]), ends)
            if not np.array_equal(have[cuts], ends):
                raise AssertionError("a token crosses a cut")
            lengths = np.diff(cuts, prepend=-1)
            if gap == "\n":
                ids = np.delete(ids, np.concatenate([[0], cuts[:-1] + 1]))
                lengths -= 1
            found.append((ids, lengths))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _forget(self) -> None:
        """Keep the half of the pieces that was used last."""
        n, old, last = self.held.n, self.held, self.last
        stays = (last[:n] > np.median(last[:n])) & (pc.utf8_length(self.known).to_numpy() <= CACHE_CHARS)
        self.known, self.held, at = self.known.filter(pa.array(stays)), _Ragged(), np.flatnonzero(stays)
        self.held.extend(*old.take(at))
        self.last = np.concatenate([last[at], np.zeros(1 << 14, np.int32)])

    def _numbers(self, pieces: list[pa.LargeStringArray]) -> list[np.ndarray]:
        """The pieces' numbers; new ones are learnt."""
        coded = pa.chunked_array([self.known, *pieces], pa.large_string()).dictionary_encode().chunks
        n, every = len(self.known), coded[-1].dictionary
        if len(every) > n:
            self._learn(every.slice(n))
            self.known = every
            while len(self.last) < len(every):
                self.last = np.concatenate([self.last, np.zeros_like(self.last)])
        # Chunks without rows are left out; the known pieces' own numbers are 0 to n.
        numbers = np.concatenate([c.indices.to_numpy() for c in coded])[n:]
        self.last[numbers] = self.block
        return np.split(numbers, np.cumsum([len(x) for x in pieces])[:-1])

    def _table(self, pieces: pa.LargeStringArray) -> _Ragged:
        """The ids of distinct pieces; one that ends in marks behind a letter has its stem's and the marks' own."""
        data, offsets = _bytes(pieces)
        stem = pc.binary_length(pc.ascii_rtrim(pieces, characters=_MARKS)).to_numpy()
        ends = offsets[:-1] + stem
        split = np.flatnonzero((stem > 0) & (ends < offsets[1:]))
        last, before = data[ends[split] - 1], data[ends[split] - 2]
        wide = (last >= 0x80) & (last < 0xC0) & (before >= 0xC3) & (before < 0xCA) & ~((before == 0xC3) & ((last == 0x97) | (last == 0xB7)))
        split = split[_ASCII_LETTERS[last] | wide]
        # Heads and tails lie behind one another in the pieces' own bytes; tails go by the mark before pieces without a space.
        cuts = np.stack([offsets[:-1], offsets[1:]], 1)
        cuts[split, 1] = ends[split]
        cuts = np.append(cuts.ravel(), offsets[-1:])
        halves = pa.LargeStringArray.from_buffers(2 * len(pieces), pa.py_buffer(cuts), pieces.buffers()[2])
        tails = halves.take(pa.array(2 * split + 1)).dictionary_encode()
        heads, marks = self._numbers([halves.take(pa.array(np.arange(0, 2 * len(pieces), 2))), pc.binary_replace_slice(tails.dictionary, 0, 0, "\0")])
        first = np.arange(len(pieces))
        first[1:] += np.cumsum(np.bincount(split, minlength=len(pieces)))[:-1]
        parts = np.empty(len(pieces) + len(split), np.int64)
        parts[first] = heads
        parts[first[split] + 1] = marks[tails.indices.to_numpy()]
        ids, lengths = self.held.take(parts)
        table = _Ragged()
        table.extend(ids, np.add.reduceat(lengths, first))
        return table

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.held.n > self.keep or self.held.used > IDS_PER_PIECE * self.keep:
            self._forget()
        self.block += 1
        out = [np.zeros(0, np.uint32)] * len(texts)
        cut, marked = [], []
        for i, text in enumerate(texts):
            if (one := _marked(text)) is None:
                out[i] = self._whole(text)
            else:
                cut.append(i)
                marked.append(one)
        if not cut:
            return out
        # A piece goes by its text without the space before it; one that has none begins with a mark that no text here holds.
        lists = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        del marked
        coded, offsets = lists.values.dictionary_encode(), lists.offsets.to_numpy()
        table, which, at = self._table(coded.dictionary), coded.indices.to_numpy(), 0
        while at < len(cut):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GATHERED_PIECES, "right")) - 1)
            ids, lengths = table.take(which[offsets[at] : offsets[to]])
            bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[offsets[at : to + 1] - offsets[at]].tolist()
            for i, a, b in zip(cut[at:to], bounds, bounds[1:], strict=False):
                out[i] = ids[a:b]
            at = to
        return out
