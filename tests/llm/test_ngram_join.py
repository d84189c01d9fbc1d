import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import ngram_join, signature_tree
from lakeloom.llm.components import components
from lakeloom.llm.shingles import shingle_sets, word_hashes


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    label = {d: d for d, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and None not in (rows[i][0], rows[j][0]) and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(rows[i][0]), root(rows[j][0])
                label[max(x, y)] = min(x, y)
    return sorted(((d, len(s), root(d)) for (d, _), s in zip(rows, sets, strict=True)), key=str)


def corpus(seed, families=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(4))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice([1, 2, 4, 9, 15, 30, 80, 300]))]
        for _ in range(rng.randrange(1, 12)):
            new = [word() if rng.random() < rng.choice([0, 0.01, 0.03, 0.1]) else w for w in base]
            texts.append(" ".join(new[: len(new) - rng.randrange(2)] if len(new) > 5 else new))
        texts.append(passage + " " + " ".join(word() for _ in range(30)))
    texts += [None, "", "  \n", "A b C", "a B c", texts[0], "one", "ONE", "x" * 100_000]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components_match_brute_force(spark, width, percent, monkeypatch):
    # With chunks of three sets groups are linked in rounds; without a filter routes are joined.
    for seed, sets, most in ((1, 512, 28), (2, 3, 0)):
        monkeypatch.setattr(ngram_join, "CHUNK_SETS", sets)
        monkeypatch.setattr(ngram_join, "FILTER_MOST", most)
        rows = corpus(seed) + [(None, "lost row"), (6, "another text of document six"), (9, "same row twice"), (9, "same row twice")]
        df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component int")
        got = ngram_join.jaccard_components(df.repartition(5), width, percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, width, percent)
    assert ngram_join.jaccard_components(df.limit(0), width, percent).count() == 0


def test_similar_sets_always_share_a_route():
    rng = np.random.default_rng(4)
    bounds = ngram_join.class_bounds(90, 5000)
    for _ in range(400):
        n = int(rng.integers(1, 600))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        most = int(len(a) * 20 / 190) + 1
        drop = int(rng.integers(0, most + 1))
        add = int(rng.integers(0, most - drop + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
        if len(b) and signature_tree.similar(a, b, 90):
            assert np.intersect1d(ngram_join.routes(a, 90, bounds), ngram_join.routes(b, 90, bounds)).size


def test_tree_join_matches_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    sets = []
    for _ in range(300):
        new, at = base.copy(), rng.choice(300, int(rng.integers(0, 60)), replace=False)
        new[at] = rng.integers(0, 2**63, len(at))
        sets.append(np.unique(new[: rng.integers(270, 301)]))
    for side in (None, np.arange(300) % 2):
        forest = signature_tree.Forest(300)
        for i in range(300):
            for j in range(i):
                if (side is None or side[i] != side[j]) and signature_tree.similar(sets[i], sets[j], 90):
                    forest.join(i, j)
        roots, compared = signature_tree.link(sets, 90, side)
        assert np.array_equal(roots, forest.flat()) and compared < 20_000


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (500, 500), (None, 3), (3, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 150), 100), 500: 500}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_shingles_of_short_texts():
    sets = shingle_sets([b"", b"a b", b"A B", b"a b c a b c", b"a  b\nc"], 3)
    assert [len(s) for s in sets] == [0, 1, 1, 3, 1] and sets[1] == sets[2] and sets[4][0] in sets[3]


def test_sets_of_one_doc_id_keep_their_own_sketches(spark):
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(8):
        base = words(1002)
        # Sketches of 128 and 64 bytes under one doc_id, of 256 for its partner.
        rows += [(10 * i, " ".join(base)), (10 * i, " ".join(words(400))), (10 * i + 1, " ".join(base + words(30)))]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 24 and {(r.doc_id, r.component_id) for r in got} == {(10 * i + k, 10 * i) for i in range(8) for k in (0, 1)}


def test_regular_words_are_told_apart(spark):
    word = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, f"{word} x y"), (4, f"{other} x y"), (5, word.upper())]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_word_hashes_are_those_of_the_words():
    rng = random.Random(3)
    pool = ["".join(rng.choice("abé日z.-") for _ in range(n)) for n in range(1, 40) for _ in range(40)]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(9))).encode() for _ in range(300)] + [b"", b"  ", b"\n a\t"]
    hashes, bounds = word_hashes(texts)
    seen = {}
    for i, t in enumerate(texts):
        words = re.findall(rb"[^\x20\x09-\x0D]+", t)
        assert bounds[i + 1] - bounds[i] == len(words)
        for w, h in zip(words, hashes[bounds[i] : bounds[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) > 500


def test_one_of_each_with_clashing_names(spark):
    rows = [(2, "a b c d e f", 1), (1, "A b c d e f", 1), (3, None, 1), (None, "a b c d e f", 1), (5, "", 1), (1, "A b c d e f", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone int").withColumn("component_id", F.lit("x"))
    got = ngram_join.keep_one(docs)
    assert got.columns == docs.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "1", "3", "5", "None"]
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


def test_rounds_connect_what_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 5)
    rng = np.random.default_rng(6)
    near = lambda a, b: abs(a - b) <= 2
    rows = [(g, 1000 * g + i, 8, int(x)) for g, top in ((1, 40), (2, 400), (3, 120)) for i, x in enumerate(rng.integers(0, top, 60))]

    def kernel(table, forest, side):
        x = table.column("x").to_pylist()
        for i in range(len(x)):
            for j in range(i):
                if (side is None or side[i] != side[j]) and abs(x[i] - x[j]) <= 2:
                    forest.join(i, j)

    links = ngram_join._in_rounds(spark.createDataFrame(rows, "g long, node long, bytes long, x long"), kernel, ["x"])
    got = {r.node: r.component for r in components(links).collect()}
    label = {r[1]: r[1] for r in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if a[0] == b[0] and near(a[3], b[3]):
                    label[a[1]] = label[b[1]] = min(label[a[1]], label[b[1]])
    assert {n: got.get(n, n) for n in label} == label
