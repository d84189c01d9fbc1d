import random
from collections import Counter

import numpy as np
import sentencepiece

from lakeloom.llm import piece_sampling as ps


def paths(sampler, pieces, word):
    """Every segmentation of a word and its weight."""
    if not word:
        return {(): 0.0}
    out = {}
    for n in range(1, min(len(word), 16) + 1):
        if (i := pieces.get(word[:n])) is not None:
            for rest, w in paths(sampler, pieces, word[n:]).items():
                out[(i, *rest)] = w + sampler.weight[int(np.flatnonzero(sampler.ids == i)[0])]
    return out


def test_samples_follow_the_lattice():
    model = sentencepiece.SentencePieceProcessor(model_file=ps.default_path())
    pieces = {model.id_to_piece(i): i for i in range(259, model.get_piece_size())}
    for alpha in (1.0, 0.3):
        sampler = ps.Sampler(alpha=alpha, seed=3)
        want = paths(sampler, pieces, "▁hello")
        total = np.logaddexp.reduce(list(want.values()))
        n = 20_000
        got = Counter(tuple(x.tolist()) for x in sampler.encode(["hello"] * n, np.arange(n)))
        assert set(got) <= set(want)
        for path, w in want.items():
            p = np.exp(w - total)
            assert abs(got[path] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_round_trips_and_reproducibility():
    rng = random.Random(9)
    bits = ["a", "hello", " ", "  ", "\n", "▁", "é", "日本", "①", "😀", "　", "ing ", "\0", "x" * 40]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(600)] + ["", " ", "▁", " ▁", "y" * 30_000]
    keys = np.array([ps.row_key(i) for i in range(len(texts))], np.uint64)
    a, b = ps.Sampler(seed=1), ps.Sampler(seed=1)
    whole = a.encode(texts, keys)
    assert [a.decode(i.tolist()) for i in whole] == texts
    order = rng.sample(range(len(texts)), len(texts))
    for at in range(0, len(order), 97):  # other batches, other order, same pieces
        some = order[at : at + 97]
        assert all(np.array_equal(x, whole[i]) for i, x in zip(some, b.encode([texts[i] for i in some], keys[some]), strict=True))
    assert any(not np.array_equal(x, y) for x, y in zip(whole, ps.Sampler(seed=2).encode(texts, keys), strict=True))
    model = sentencepiece.SentencePieceProcessor(model_file=ps.default_path())
    assert all(model.decode(i.tolist()) == t for i, t in zip(whole, texts, strict=True) if "▁" not in t)


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_regular_words_are_told_apart():
    word = thue_morse(2048)
    texts = [word, word.translate(str.maketrans("ab", "ba")), f"{word} x {word[::-1]}"]
    sampler = ps.Sampler()
    assert [sampler.decode(i.tolist()) for i in sampler.encode(texts, np.arange(3))] == texts


def test_rows(spark):
    rows = [(1, "some text", 1), (1, "some text", 1), (2, None, 1), (3, "", 1), (4, "word " * 30_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = ps.digests(df).collect()
    assert len(got) == 5 and all(r.lossless for r in got) and len({r.ids_crc32 for r in got if r.doc_id == 1}) == 1
    assert {r.n_pieces for r in got if r.doc_id in (2, 3)} == {0}
    back = ps.decode(ps.encode(df)).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((k, t or "") for k, t, _ in rows)
    assert ps.digests(df.limit(0)).count() == 0
