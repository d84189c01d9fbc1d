import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from lakeloom.llm import token_files as files
from lakeloom.llm import tokens
from lakeloom.llm.common import new_folder


def whole(texts):
    t = Tokenizer.from_file(tokens.default_path())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    bits = [" ", "\n", "\t", "a", "1", ".", ",", "é", "'", "'s", "\x1c", "\x85", "\0", "Word", " word.", " x,", "end.\nNext", "\n\n", "\r\n", "!?", "é$$&", "\"", "|>.", "  ", "<|endoftext|>", "日本", "don't"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(4000)] + ["", " ", "a ", " a"]
    encoder = tokens.Encoder()
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        assert [ids.tolist() for ids in encoder.encode(some)] == whole(some)


def test_forgotten_pieces_are_learnt_again(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 50)
    rng = random.Random(2)
    encoder = tokens.Encoder()
    for _ in range(30):
        some = [" ".join(rng.choice(["one", "two", "x" * 70, "longer!", str(rng.random())]) for _ in range(rng.randrange(30))) for _ in range(6)]
        assert [ids.tolist() for ids in encoder.encode(some)] == whole(some)
    assert encoder.held.n < 500


def test_words_and_marks_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens, "JOINED_PIECES", 3)
    monkeypatch.setattr(tokens, "GATHERED_PIECES", 7)
    rng = random.Random(3)
    # Letters, signs among them, letters beyond those of long standing, digits, white space that isn't a space, marks.
    letters = "aZéÀÖ×ØöøÿĀɏɐɿʀͰжﬁªºµ²½"
    marks = ["", ".", ",", ",&&&", "...", "'s", "'", ")", "\u00a0", "\u0085", "\u3000", "\t", "7", "|>", "\"", "\x7f", "…"]
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(5))) + rng.choice(marks) for _ in range(3000)]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n"]) for _ in range(rng.randrange(12))).strip(" ") for _ in range(2000)]
    texts += ["", ".", "\n", "a", "a.", "×.", "÷,", "ÿ!", "! !", "a\n.", ". a.", " ".join(words)]
    encoder, expected = tokens.Encoder(), whole(texts)
    for size in (1, 40, len(texts)):
        got = [ids.tolist() for at in range(0, len(texts), size) for ids in encoder.encode(texts[at : at + size])]
        assert got == expected


def test_kept_pieces_take_little_memory():
    """A worker keeps as many pieces as its memory holds: 100 bytes each at most, and nothing for marks behind known words."""
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoin") for _ in range(9)) for _ in range(30_000)]
    encoder = tokens.Encoder()
    tracemalloc.start()
    before = pa.total_allocated_bytes()
    encoder.encode([" ".join(words)])
    n, taken = encoder.held.n, tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert n >= 29_000 and taken < 100 * n
    encoder.encode([" ".join(w + "," for w in words)])
    assert encoder.held.n < n + 5


def test_planes_round_trip():
    ids = np.random.default_rng(2).integers(0, 2**32, 1001).astype("<u4")
    for bits in (False, True):
        planes = files.to_planes(ids, bits)
        assert len(planes) == (32 if bits else 4) and np.array_equal(files.from_planes(planes, len(ids)), ids)
    parts = [b"ab", b"", b"cdefgh" * 999]
    assert files.crc32_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_files_hold_documents_in_order(spark):
    texts = {5: "one two", 1: None, 9: "", 3: "long text " * 700, 7: "é\n\nx"}
    rows = [(k, v, "c") for k, v in texts.items()] + [(9, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    for bits in (False, True):
        path = new_folder(spark, "t")
        files.write(docs, path, block_ids=64, bits=bits)
        got = sorted(files.read_digests(spark, path).collect(), key=lambda r: r.start)
        ids = [whole([t or ""])[0] + [0] for _, t, _ in sorted(rows, key=lambda r: r[0])]
        assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
        assert [r.n_tokens for r in got] == [len(x) for x in ids]
        assert [r.start for r in got] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
        assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
        assert [i for r in sorted(files.read_ids(spark, path).collect(), key=lambda r: (r.shard, r.first)) for i in r.ids] == sum(ids, [])
    path = new_folder(spark, "t")
    files.write(docs.limit(0), path)
    assert files.read_digests(spark, path).count() == 0
