import re

import corpus_pipeline
from lakeloom.llm import quality_classifier, quality_rules, secret_scan, tokens
from lakeloom.llm.common import stored

DATA = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, out = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, DATA), name)
        rows, kept = before.collect(), after.collect()
        texts = {r.doc_id: r.text for r in rows}
        if name == "quality_rules":
            verdict = quality_rules.judge(before).where("kept").collect()
            assert {r.doc_id for r in kept} == {r.doc_id for r in verdict}
            assert not any(quality_rules.fails(*(quality_rules.measure(r.text)[k] for k in (0, 4))) for r in kept)
        elif name == "quality_classifier":
            model = quality_classifier.fit(before)
            assert {r.doc_id for r in kept} == {d for d, t in texts.items() if quality_classifier.score([t], model)[0] >= quality_classifier.THRESHOLD}
        elif name == "ngram_jaccard_join":
            sets, label = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

            def root(x):
                while label[x] != x:
                    x = label[x]
                return x

            ids = sorted(texts)
            for i, a in enumerate(ids):
                for b in ids[:i]:
                    if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        x, y = root(a), root(b)
                        label[max(x, y)] = min(x, y)
            assert {r.doc_id for r in kept} == {d for d in ids if root(d) == d}
        elif name == "secret_scans":
            assert {r.doc_id for r in kept} == set(texts)
            found = secret_scan.Scanner(secret_scan.RULES).scan([r.text for r in kept])
            assert not any(s[1] == 2 for spans in found for s in spans) and all(r.n_chars == len(r.text) for r in kept)
        else:
            encoder = tokens.Encoder()
            assert sum(r.n_tokens for r in kept) == sum(len(encoder.encode([t])[0]) for t in texts.values())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == docs.columns
        before, out = after, kept
    assert len(corpus_pipeline.run(spark, DATA).collect()) == len(out)


def test_edge_rows_pass_through_all_stages(spark, tmp_path):
    prose = lambda w: " ".join(f"The {w}{i} house was in the old town{i}, and the garden{i} of it was green." for i in range(12))
    red, blue, green = map(prose, ("red", "blue", "green"))
    rows = [
        (1, red, "en", "a.example", 1), (2, red, "en", "a.example", 1), (3, blue + " token=abcdef0123456789", None, None, None), (4, None, "en", "a.example", 0),
        (5, "", "en", "a.example", 0), (6, green, "en", "b.example", 7), (6, green, "en", "b.example", 7), (8, "few words", "en", "b.example", 9), (9, "x" * 300_000, "en", "b.example", 7),
    ]
    given = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = given.unionByName(spark.createDataFrame([(10**6 + r[0], *r[1:]) for r in rows] + [(None, prose("grey"), "en", "b.example", 7)], given.schema))
    docs.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    packed = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "some")).collect()]
    # The first of equal texts stays, repeated rows and a null id too; short, empty and null texts go.
    assert {d - 10**6 for d in packed if d and d > 10**6} == {1, 3, 6} and packed.count(10**6 + 6) == 2 and None in packed
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
