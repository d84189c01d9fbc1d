import random
import re

from pyspark.sql import functions as F

from lakeloom.llm import quality_rules as rules

SCHEMA = "doc_id long, text string, source string, n_words string"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measure_matches_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a ", "b ", "é\n", "x y ", "#|", "\t", "a b a b a b a b ", " "]) for _ in range(rng.randrange(60)))
        assert rules.measure(text) == brute(text), text


def test_edge_rows_and_clashing_columns(spark):
    rows = [(1, None, "a", "x"), (2, "", None, "x"), (3, "w " * 30, "a", None), (3, "w " * 30, "a", None), (None, " ".join(map(str, range(50000))), "b", "y")]
    out = rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 5
    by = {r.doc_id: r for r in out}
    assert by[1].n_words == 0 and by[1].base_failed and by[3].n_repeat_words == 30 and by[3].base_failed
    assert by[None].n_words == 50000 and by[None].kept
    assert rules.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_host_of_failures_is_rejected(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good if i % 40 else "short", f"h{i % 5}", "") for i in range(2000)] + [(5000 + i, "short" if i % 10 else good, "bad", "") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    verdict = {r.doc_id: r.kept for r in rules.judge(docs).collect()}
    assert verdict[1] and not verdict[5000]  # 5000 is good text on the bad host
    kept = rules.reject(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, v in verdict.items() if v}


def test_reject_with_clashing_names(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good, "h", "a"), (2, "few words", "h", "a"), (3, None, None, "a"), (4, good, None, "a"), (4, good, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rejected_host string").withColumn("REJECTED_HOST_", F.lit(1))
    got = rules.reject(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 4, 4]
    assert rules.reject(docs.limit(0)).count() == 0
