"""A quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. The counts of
vote patterns, a table bounded by 3 ** labellers, are all that
expectation-maximisation needs to estimate how each labeller votes on good and
on bad documents; each pattern gets a posterior. A linear scorer over hashed
byte n-grams and text shapes is then trained on posterior labels of a bounded
sample and scores every document.

Null text counts as empty; an empty text scores 0 and isn't kept. Repeated
rows get equal scores; texts of any length are scored whole; a score equal to
the threshold keeps its document. Only the id and the text are read, so other
columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import operator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, pieces_by_size, text_of
from .quality_rules import measure

#: Buckets of hashed features; length of byte n-grams.
BUCKETS, GRAM = 4096, 4
#: Expected number of distinct texts that train the scorer; at most twice as many are taken.
SAMPLE = 2000
#: Documents with a lower score aren't kept.
THRESHOLD = 0.25
BLOCK_BYTES = 1 << 21
ROUNDS = 60

# Frequent function words of the four languages.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that for it was on with as by are this be at or from "
    b"der die und das den von zu mit sich des auf ist im nicht ein eine als auch dem "
    b"de la le et les des en un une du que pour dans qui sur par au pas plus avec "
    b"el los las del que y se no una por con para su al lo es".split()
)


_ENDS = re.compile(r"[.!?](?=[ \t\n\v\f\r]|$)")


@functools.cache
def _letter_kinds() -> np.ndarray:
    """For each code point 0, 1 (letter) or 3 (capital letter)."""
    return np.array([(1 + 2 * c.isupper()) * c.isalpha() for c in map(chr, range(0x110000))], np.uint8)


def shape(text: str) -> np.ndarray:
    """Shares that labellers and features are made of, of a text with words."""
    n_words, word_chars, symbols, _, repeat = measure(text)
    kinds = np.bincount(_letter_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=4)
    letters = max(1, int(kinds[1] + kinds[3]))
    low = text.lower().encode("utf-8", "surrogatepass").translate(None, b".,;:!?").split()
    return np.array(
        [
            symbols / n_words,
            kinds[3] / letters,
            repeat / n_words,
            text.count("!") / n_words,
            sum(map(FUNCTION_WORDS.__contains__, low)) / n_words,
            len(_ENDS.findall(text)) / n_words,
            sum(map(operator.eq, low, low[1:])) / n_words,
            letters / max(1, word_chars),
            n_words,
        ]
    )


# Votes: 2 good, 1 bad, 0 none.
def _vote(bad: bool, good: bool) -> int:
    return 1 if bad else 2 if good else 0


LABELLERS = (
    ("symbols", lambda s: _vote(s[0] > 0.1, s[0] < 0.02)),
    ("capitals", lambda s: _vote(s[1] > 0.4, s[1] < 0.2)),
    ("repeated_windows", lambda s: _vote(s[2] > 0.3, s[2] < 0.1 and s[8] >= 20)),
    ("exclamations", lambda s: _vote(s[3] > 0.2, s[3] < 0.05)),
    ("function_words", lambda s: _vote(s[4] < 0.03 and s[8] >= 30, s[4] > 0.08)),
    ("sentences", lambda s: _vote(s[5] < 0.005 and s[8] >= 60 or s[5] > 0.6, 0.01 < s[5] < 0.35)),
    ("echoes", lambda s: _vote(s[6] > 0.15, s[6] < 0.05)),
    ("letters", lambda s: _vote(s[7] < 0.75, s[7] > 0.9)),
)


def votes(shapes: np.ndarray | None) -> int:
    """The vote pattern, a base-3 number; 0 for a text without words."""
    return 0 if shapes is None else sum(vote(shapes) * 3**k for k, (_, vote) in enumerate(LABELLERS))


def fit_labellers(counts: dict[int, int], rounds: int = ROUNDS) -> dict[int, float]:
    """The posterior of good for each vote pattern, by expectation-maximisation over pattern counts.

    Labellers are taken to be independent given the class. Majority votes
    start it; counts are smoothed by one.
    """
    patterns = np.array(sorted(counts))
    weight = np.array([counts[p] for p in patterns], float)
    digits = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    lead = (digits == 2).sum(1) - 2.0 * (digits == 1).sum(1)
    good = 1 / (1 + np.exp(-lead))
    for _ in range(rounds):
        score = np.zeros((len(patterns), 2))
        for c, share in enumerate((1 - good, good)):
            mass = weight * share
            score[:, c] = np.log((mass.sum() + 1) / (weight.sum() + 2))
            for k in range(len(LABELLERS)):
                table = np.bincount(digits[:, k], mass, 3) + 1
                score[:, c] += np.log(table / table.sum())[digits[:, k]]
        good = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))
    return dict(zip(patterns.tolist(), good.tolist(), strict=True))


def features(texts: list[bytes], shapes: list[np.ndarray | None]) -> np.ndarray:
    """Unit rows of hashed features: square roots of byte n-gram counts, and rounded shapes."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    data = np.frombuffer(b"".join(texts) + b"\0" * GRAM, np.uint8).astype(np.uint32)
    code = np.zeros(len(data) - GRAM, np.uint32)
    for k in range(GRAM):
        code = code * np.uint32(257) + data[k : k + len(code)]
    code = (code * np.uint32(2654435761)) >> np.uint32(20)
    at = 0
    for i, (text, s) in enumerate(zip(texts, shapes, strict=True)):
        if s is None:
            at += len(text)
            continue
        row = np.sqrt(np.bincount(code[at : at + max(0, len(text) - GRAM + 1)], minlength=BUCKETS).astype(np.float32))
        row /= np.linalg.norm(row) or 1
        for k, x in enumerate(s[:-1]):
            row[(k * 1021 + min(10, int(10 * x)) * 331 + 7) % BUCKETS] += 0.5
        out[i], at = row / (np.linalg.norm(row) or 1), at + len(text)
    return out


def train(rows: np.ndarray, labels: np.ndarray, rounds: int = 200, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by gradient steps with momentum."""
    # Single precision throughout: a mixed product would copy the rows each round.
    weights, bias = np.zeros(rows.shape[1], np.float32), 0.0
    speed, push, rate = np.zeros_like(weights), 0.0, 8.0
    labels = labels.astype(np.float32)
    # The rarer class counts as much as the other.
    share = min(max(labels.mean(), 0.01), 0.99)
    emphasis = labels / share + (1 - labels) / (1 - share)
    for _ in range(rounds):
        gap = (emphasis * (1 / (1 + np.exp(-(rows @ weights + np.float32(bias)))) - labels) / len(labels)).astype(np.float32)
        speed = np.float32(0.9) * speed - np.float32(rate) * (gap @ rows + np.float32(penalty) * weights)
        push = 0.9 * push - rate * 0.1 * float(gap.sum())
        weights, bias = weights + speed, bias + push
    return weights, bias


def _shapes(texts: list[str]) -> list[np.ndarray | None]:
    return [shape(t) if t.strip(" \t\n\v\f\r") else None for t in texts]


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and bias trained on docs: labellers on all, the scorer on about sample distinct texts."""
    df = docs.select(text_of(text)).withColumn("hash", F.xxhash64("text", F.lit(7)))

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [votes(s) for p in pieces_by_size(batch, "text", BLOCK_BYTES) for s in _shapes(p.column(0).to_pylist())]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), batch.column(1)], names=["pattern", "hash"])

    counts, distinct = {}, 0
    # Equal texts have equal patterns, so distinct texts add up over patterns; the estimate knows neither copies nor row order.
    for r in map_texts(df, vote, "pattern int, hash long").groupBy("pattern").agg(F.count("*").alias("n"), F.approx_count_distinct("hash").alias("texts")).toLocalIterator():
        counts[r.pattern] = r.n
        distinct += r.texts
    if not counts:
        return np.zeros(BUCKETS, np.float32), 0.0
    posterior = fit_labellers(counts)

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).to_pylist()
        shapes = _shapes(texts)
        rows = features([t.encode("utf-8", "surrogatepass") for t in texts], shapes)
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([posterior[votes(s)] for s in shapes]), pa.array([r.tobytes() for r in rows], pa.binary())], names=["place", "good", "row"])

    # Each distinct text stands once in the draw, so that copies can't fill it, and the least hashes are taken, in their order.
    part = min(1.0, sample / max(1, distinct))
    placed = df.select("text", F.pmod("hash", F.lit(1 << 30)).alias("place"))
    drawn = placed.where(F.col("place") < int(part * (1 << 30))).where("text <> ''").distinct()
    got = map_texts(drawn, describe, "place long, good double, row binary").orderBy("place", "good", "row").limit(2 * sample).toLocalIterator()
    labels, rows = [], []
    for r in got:
        labels.append(r.good)
        rows.append(np.frombuffer(r.row, np.float32))
    if not rows:
        return np.zeros(BUCKETS, np.float32), 0.0
    return train(np.stack(rows), np.array(labels))


def score(texts: list[str], model: tuple[np.ndarray, float]) -> np.ndarray:
    """Scores in 0..1; 0 for texts without words."""
    shapes = _shapes(texts)
    # Row by row: a matrix product may round a row differently with its place.
    raw = (features([t.encode("utf-8", "surrogatepass") for t in texts], shapes) * model[0]).sum(1) + model[1]
    return np.where([s is None for s in shapes], 0.0, 1 / (1 + np.exp(-raw.astype(float))))


def classify(docs: DataFrame, model: tuple[np.ndarray, float] | None = None, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and kept of every row."""
    model = model or fit(docs, text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.concatenate([score(p.column(1).to_pylist(), model) for p in pieces_by_size(batch, "text", BLOCK_BYTES)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(found >= threshold)], names=["doc_id", "score", "kept"])

    df = docs.select(F.col(doc_id).alias("doc_id"), text_of(text))
    return map_texts(df, work, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, score double, kept boolean")


def reject(docs: DataFrame, model: tuple[np.ndarray, float] | None = None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score below the threshold, all columns as they were."""
    model = model or fit(docs, text)
    at = docs.columns.index(text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.concatenate([score([t or "" for t in p.column(at).to_pylist()], model) for p in pieces_by_size(batch, docs_columns[at], BLOCK_BYTES)])
        return batch.filter(pa.array(found >= threshold))

    docs_columns = docs.columns
    return map_texts(docs, work, docs.schema)
