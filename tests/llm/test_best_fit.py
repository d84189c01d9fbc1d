import random
from collections import defaultdict

import pytest

from lakeloom.llm import best_fit, tokens


def one_by_one(lengths, sizes, overhead):
    """The same rule, a piece at a time."""
    bins, left = [], sum(lengths)
    order = sorted(lengths, reverse=True)
    for i, n in enumerate(order):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            size = best_fit.least_cost_size(n, order[i:].count(n), left, sizes, overhead)
            bins.append(b := [size, []])
        b[0] -= n
        b[1].append(n)
        left -= n
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_a_packing_no_worse_than_one_by_one(seed):
    rng = random.Random(seed)
    sizes = (16, 32, 64)
    lengths = [rng.choice([1, 2, 3, 5, 8, 13, 17, 31, 40, 63, 64]) if seed % 2 else rng.randrange(1, 65) for _ in range(400)]
    bins = best_fit.plan({n: lengths.count(n) for n in set(lengths)}, sizes, 4)
    packed = [n for b in bins for n in b.lengths * b.count]
    assert sorted(packed) == sorted(lengths)
    assert all(sum(b.lengths) <= b.size and not any(sum(b.lengths) <= s < b.size for s in sizes) for b in bins)
    shrunk = lambda total: next(s for s in sizes if s >= total)
    mine = sum(b.count * best_fit.cost(b.size, 4) for b in bins)
    single = sum(best_fit.cost(shrunk(sum(held)), 4) for _, held in one_by_one(lengths, sizes, 4))
    assert mine <= 1.03 * single
    largest = one_by_one(lengths, (64,), 4)
    assert mine <= 1.03 * sum(best_fit.cost(64, 4) for _ in largest)


def check(rows, lengths, sizes):
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        if r.bin is not None:
            by_bin[r.bin].append(r)
    for doc, n in lengths.items():
        got = sorted(by_doc[doc], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in got) == n and [r.start for r in got] == [max(sizes) * k for k in range(len(got))]
    for held in by_bin.values():
        held.sort(key=lambda r: r.bin_offset)
        assert len({r.bin_size for r in held}) == 1 and held[0].bin_offset == 0
        assert all(a.bin_offset + a.n_tokens == b.bin_offset for a, b in zip(held, held[1:], strict=False))
        total = held[-1].bin_offset + held[-1].n_tokens
        assert held[0].bin_size == min(s for s in sizes if s >= total)
    assert sorted(by_bin) == list(range(len(by_bin)))


def test_every_piece_has_its_place(spark):
    rng = random.Random(2)
    lengths = {i: rng.choice([0, 7, 7, 7, 7, 7, rng.randrange(400)]) for i in range(900)}
    rows = [(k, v, 0) for k, v in lengths.items()] + [(10_000, None, 0), (10_001, 123_456, 0)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, bin int").repartition(5)
    got = best_fit.pack(df, sizes=(32, 64, 128)).collect()
    check(got, lengths | {10_000: 0, 10_001: 123_456}, (32, 64, 128))
    again = best_fit.pack(df.repartition(2), sizes=(32, 64, 128)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert best_fit.pack(df.limit(0)).count() == 0


def test_documents(spark):
    texts = {1: "some words here " * 900, 2: None, 3: "", 4: "short", 5: "x " * 30_000}
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [(4, "short", 1)], "doc_id long, text string, piece int")
    encoder = tokens.Encoder()
    lengths = {k: len(encoder.encode([v or ""])[0]) for k, v in texts.items()}
    lengths[4] *= 2
    rows = best_fit.pack_documents(docs).collect()
    assert sum(r.n_tokens for r in rows) == sum(lengths.values())
    assert len([r for r in rows if r.doc_id == 4]) == 2 and {r.bin for r in rows if r.doc_id in (2, 3)} == {None}
