"""Secret scanning over a trigram inverted index.

Each rule's regular expression is parsed into a Boolean query over trigrams
that any match must contain. For every block of texts an inverted index maps
those trigrams to postings (the texts that contain them, letters folded to
lower case); a query's postings are intersected and united, and the regular
expression runs on the candidates only. A rule without a mandatory trigram
runs on every text. Blocks are independent, so nothing is shuffled.

Null text counts as empty and gives an empty row; repeated rows each give
theirs; texts of any length are scanned whole; spans that begin together stand
in the order of the rules; offsets are code points, ends exclusive. Only the
id and the text are read, so other columns may have any name; redact keeps all
columns, null texts too. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from re import _constants as sre
from re import _parser as sre_parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OncePerTask, map_texts, pieces_by_size, text_of


class Rule(NamedTuple):
    """A kind of secret: matches of pattern whose group has min_length characters or more.

    Matching is ASCII-only; with fold, letters match in either case.
    """

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 0
    fold: bool = False


# The base kinds, then well-known public token formats. None goes back over a run that it has read,
# so that time grows with a text's length whatever it holds.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----)?"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]{20,}", fold=True),
    Rule("url_login", r"[a-z][a-z0-9+.-]{0,30}://[^\s/:@]++:[^\s/:@]++@", fold=True),
)
RULES = BASE_RULES + MORE_RULES

#: Bytes of text in a block that is indexed at once.
BLOCK_BYTES = 1 << 22
#: Most strings followed as an exact set while a pattern is analysed.
MAX_EXACT = 32

# A query is True (anything), a trigram, or ("and" | "or", parts).


def _both(kind: str, parts: list) -> object:
    """The conjunction or disjunction of parts, simplified."""
    if kind == "or" and any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _strings(found: set[str]) -> object:
    """The query for text that contains one of the strings."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(found)])


def _analyse(items) -> tuple[set[str] | None, object]:
    """(all strings that items match if they are few, else None; the query every match satisfies)."""
    run, queries, exact = {""}, [], True
    for op, arg in items:
        strings, query = _item(op, arg)
        if strings is not None and len(run) * len(strings) <= MAX_EXACT:
            run = {a + b for a in run for b in strings}
            continue
        queries += [_strings(run), query if strings is None else _strings(strings)]
        run, exact = ({""} if strings is None else strings), False
    if exact:
        return run, _strings(run)
    return None, _both("and", [*queries, _strings(run)])


def _item(op, arg) -> tuple[set[str] | None, object]:
    if op is sre.LITERAL:
        return {chr(arg).lower()}, True
    if op is sre.IN and arg[0][0] is not sre.NEGATE:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < MAX_EXACT:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 8 else (None, True)
    if op is sre.SUBPATTERN:
        return _analyse(arg[-1])
    if op is sre.BRANCH:
        parts = [_analyse(p) for p in arg[1]]
        union = set().union(*(p[0] or set() for p in parts))
        if all(p[0] is not None for p in parts) and len(union) <= MAX_EXACT:
            return union, _strings(union)
        return None, _both("or", [p[1] for p in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        strings, query = _analyse(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, True
        if low == high and strings is not None and len(strings) ** low <= MAX_EXACT:
            run = {""}
            for _ in range(low):
                run = {a + b for a in run for b in strings}
            return run, True
        return None, query if low else True
    return ({""}, True) if op is sre.AT else (None, True)


def trigram_query(rule: Rule) -> object:
    """The Boolean query that each match of the rule satisfies; True if there is none."""
    return _analyse(sre_parser.parse(rule.pattern, re.ASCII))[1]


def trigrams_in(query: object) -> set[str]:
    """The trigrams a query names."""
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1]))


def _code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


class Scanner:
    """Compiled rules and the trigrams to index; lives on a worker."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.regexes = [re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.fold else 0)) for r in rules]
        self.queries = [trigram_query(r) for r in rules]
        names = sorted(t for t in set().union(*map(trigrams_in, self.queries)) if t.isascii())
        self.number = {t: i for i, t in enumerate(names)}
        #: Trigram code → its number + 1, else 0.
        self.table = np.zeros(1 << 24, np.uint16)
        self.table[[_code(t.encode()) for t in names]] = np.arange(1, len(names) + 1)
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def index(self, texts: list[bytes]) -> dict[int, np.ndarray]:
        """Postings: trigram number → sorted positions of the texts that contain it."""
        data = self.fold[np.frombuffer(b"\0\0".join(texts) + b"\0\0", np.uint8)]
        starts = np.cumsum([0, *(len(t) + 2 for t in texts)])
        code = data[:-2].astype(np.uint32) << 16
        code |= data[1:-1].astype(np.uint32) << 8
        code |= data[2:]
        found = self.table[code]
        at = np.flatnonzero(found)
        if not len(at):
            return {}
        text_no = np.searchsorted(starts, at, side="right") - 1
        pairs = np.unique(found[at].astype(np.int64) << 40 | text_no)
        number, text_no = (pairs >> 40) - 1, pairs & ((1 << 40) - 1)
        cuts = np.flatnonzero(np.diff(number, prepend=-1))
        return {int(number[a]): text_no[a:b] for a, b in zip(cuts, [*cuts[1:], len(number)], strict=True)}

    def candidates(self, query: object, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        """Positions of the texts that satisfy the query."""
        if query is True:
            return np.arange(n)
        if isinstance(query, str):
            return postings.get(self.number[query], np.empty(0, np.int64)) if query in self.number else np.arange(n)
        parts = sorted((self.candidates(q, postings, n) for q in query[1]), key=len)
        out = parts[0]
        for part in parts[1:]:
            out = np.intersect1d(out, part, assume_unique=True) if query[0] == "and" else np.union1d(out, part)
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule number, end), sorted."""
        postings = self.index([t.encode("utf-8", "surrogatepass") for t in texts]) if texts else {}
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, regex, query) in enumerate(zip(self.rules, self.regexes, self.queries, strict=True)):
            for i in self.candidates(query, postings, len(texts)):
                spans[i] += [(m.start(), k, m.end()) for m in regex.finditer(texts[i]) if len(m[rule.group]) >= rule.min_length]
        for found in spans:
            found.sort()
        return spans


def _joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, n_base: int = len(BASE_RULES)) -> DataFrame:
    """doc_id, a count n_<kind> of each of the first n_base rules, base_sha256 and spans of every row."""

    scanner = OncePerTask(lambda: Scanner(rules))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, spans = [[] for _ in range(n_base)], [], []
        for piece in pieces_by_size(batch, "text", BLOCK_BYTES):
            for found in scanner().scan(piece.column("text").to_pylist()):
                base = [s for s in found if s[1] < n_base]
                for k in range(n_base):
                    counts[k].append(sum(s[1] == k for s in base))
                digests.append(hashlib.sha256(_joined(base, rules).encode()).hexdigest())
                spans.append(_joined(found, rules))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans)], names=names)

    df = docs.select(F.col(doc_id).alias("doc_id"), text_of(text))
    names = ["doc_id", *(f"n_{r.kind}" for r in rules[:n_base]), "base_sha256", "spans"]
    kinds = [df.schema["doc_id"].dataType.simpleString(), *["long"] * n_base, "string", "string"]
    return map_texts(df, work, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, n_chars: str | None = None, mark: str = "[{kind}]") -> DataFrame:
    """docs with each secret replaced by a mark of its kind; overlapping spans become one, named after the first.

    All columns stay; n_chars, if named, gets the new length of changed texts.
    """
    at, names = docs.columns.index(text), docs.columns
    scanner = OncePerTask(lambda: Scanner(rules))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, lengths = [], batch.column(names.index(n_chars)).to_pylist() if n_chars else []
        for piece in pieces_by_size(batch, names[at], BLOCK_BYTES):
            old = piece.column(at).to_pylist()
            for t, found in zip(old, scanner().scan([t or "" for t in old]), strict=True):
                if found:
                    out, done = [], 0
                    for a, k, b in found:
                        if a >= done:
                            out += [t[done:a], mark.format(kind=rules[k].kind)]
                        done = max(done, b)
                    t = "".join([*out, t[done:]])
                    if n_chars:
                        lengths[len(texts)] = len(t)
                texts.append(t)
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if n_chars:
            columns[names.index(n_chars)] = pa.array(lengths, batch.schema.field(names.index(n_chars)).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_texts(docs, work, docs.schema)
