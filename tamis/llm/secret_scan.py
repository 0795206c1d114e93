"""Secret scans by a trigram index.

Each rule's pattern is read as a syntax tree, from which a Boolean query on trigrams follows: every match must
hold the trigrams of the query. A batch of texts is indexed by the trigrams that some query names (a posting
list of texts for each), queries are answered by intersecting and uniting posting lists, and only the texts
found are searched with the pattern. A rule whose pattern forces no trigram scans every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser as syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytesvec as bv
from .common import arrow_limits, tidy


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts (0: the whole match), and the length that it needs.
    group: int = 0
    least: int = 0


#: Base rules first, in the order that their spans are listed in; then those that the method adds.
BASE_RULES = (
    Rule("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
ADDED_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{20,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + ADDED_RULES

# ---- trigram queries -------------------------------------------------------------------------------------
# A query is True (anything), a trigram, or ("and" | "or", frozenset of queries). Trigrams are lower-cased:
# the index folds case, so that patterns that ignore case need no more trigrams.

_MANY = 64  # strings of an exact set, before it is summed up by its trigrams


def _all_of(*queries):
    parts: set = set()
    for q in queries:
        if q is True:
            continue
        parts |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q}
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def _any_of(*queries):
    if any(q is True for q in queries):
        return True
    parts: set = set()
    for q in queries:
        parts |= q[1] if isinstance(q, tuple) and q[0] == "or" else {q}
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _of_strings(strings: set[str]):
    """What a text holds if it holds one of the strings."""
    return _any_of(*(_all_of(*(s[k : k + 3] for k in range(len(s) - 2))) for s in strings)) if strings else True


class _Seen:
    """What is known of a part of a pattern: all strings that it matches (exact), or a query."""

    def __init__(self, exact: set[str] | None, query=True):
        self.exact, self.query = exact, query

    def known(self):
        return self.query if self.exact is None else _all_of(self.query, _of_strings(self.exact))


def _read(tree) -> _Seen:
    """Strings and query of a sequence of syntax nodes: runs of exact parts are multiplied out."""
    done, run, whole = True, {""}, True
    for op, arg in tree:
        part = _node(op, arg)
        if part.exact is not None and len(part.exact) * len(run) <= _MANY:
            run = {a + b for a in run for b in part.exact}
            done = _all_of(done, part.query)
        else:
            done, whole = _all_of(done, _of_strings(run), part.known()), False
            run = {""}
            if part.exact is not None and len(part.exact) <= _MANY:
                run = part.exact  # the next parts may follow it directly
    return _Seen(run, done) if whole else _Seen(None, _all_of(done, _of_strings(run)))


def _node(op, arg) -> _Seen:
    name = str(op)
    if name == "LITERAL":
        return _Seen({chr(arg).lower()})
    if name == "IN":
        chars: set[str] = set()
        for o, a in arg:
            if str(o) == "LITERAL":
                chars.add(chr(a).lower())
            elif str(o) == "RANGE":
                if a[1] - a[0] > _MANY:
                    return _Seen(None)
                chars |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return _Seen(None)
        return _Seen(chars) if len(chars) <= 8 else _Seen(None)
    if name == "SUBPATTERN":
        return _read(arg[3])
    if name == "BRANCH":
        parts = [_read(b) for b in arg[1]]
        if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= _MANY:
            return _Seen(set().union(*(p.exact for p in parts)), _any_of(*(p.query for p in parts)))
        return _Seen(None, _any_of(*(p.known() for p in parts)))
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, inner = arg
        if most == 1 and least == 0:
            part = _read(inner)
            return _Seen({""} | part.exact) if part.exact is not None and part.query is True else _Seen(None)
        if least == 0:
            return _Seen(None)
        part = _read(inner)
        if part.exact is not None and least == most and len(part.exact) ** least <= _MANY:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in part.exact}
            return _Seen(out, part.query)
        return _Seen(None, part.known())
    if name == "AT":
        return _Seen({""})
    return _Seen(None)


def trigram_query(pattern: str):
    """The Boolean trigram query that every match of the pattern meets; True if there is none."""
    return _read(syntax.parse(pattern)).known()


def _trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(_trigrams(q) for q in query[1]))


class Index:
    """Postings of a batch's texts for a given set of ASCII trigrams, case folded."""

    def __init__(self, trigrams: set[str]):
        self.number = {t: k for k, t in enumerate(sorted(trigrams))}
        self.table = np.full(1 << 21, -1, np.int32)  # by 3 x 7 bits
        for t, k in self.number.items():
            self.table[(ord(t[0]) << 14) | (ord(t[1]) << 7) | ord(t[2])] = k

    def postings(self, raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """For each trigram, the texts of the run that hold it, in order."""
        none = [np.zeros(0, np.int64)] * len(self.number)
        if len(raw) < 3 or not self.number:
            return none
        b = bv.LOWER[raw].astype(np.int32)
        ascii3 = (raw[:-2] < 128) & (raw[1:-1] < 128) & (raw[2:] < 128)
        code = ((b[:-2] & 127) << 14) | ((b[1:-1] & 127) << 7) | (b[2:] & 127)
        number = self.table[code]
        place = np.flatnonzero((number >= 0) & ascii3)
        text = np.searchsorted(at, place, "right") - 1
        inside = place + 3 <= at[text + 1]
        pair = np.unique(number[place[inside]].astype(np.int64) * len(at) + text[inside])
        cut = np.searchsorted(pair, np.arange(len(self.number) + 1) * len(at))
        return [pair[cut[k] : cut[k + 1]] % len(at) for k in range(len(self.number))]

    def answer(self, query, postings: list[np.ndarray], texts: int) -> np.ndarray:
        if query is True:
            return np.arange(texts)
        if isinstance(query, str):
            return postings[self.number[query]]
        parts = sorted((self.answer(q, postings, texts) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def find(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Spans (code points) of the rule's matches, leftmost and non-overlapping; matches that are too short drop out."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _runs_of(rule: Rule) -> np.ndarray | None:
    """The byte table of a rule that is one repeated ASCII class, so that its long runs can be found at once."""
    tree = list(syntax.parse(rule.pattern))
    if rule.group or len(tree) != 1 or str(tree[0][0]) != "MAX_REPEAT" or tree[0][1][0] > 1 or len(tree[0][1][2]) != 1:
        return None
    one = re.compile(rule.pattern)
    table = np.zeros(256, bool)
    table[[c for c in range(128) if one.fullmatch(chr(c))]] = True
    return table if not one.fullmatch("é") else None


def _scan_rows(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        queries = [trigram_query(r.pattern) for r in rules]
        index = Index(set().union(*(_trigrams(q) for q in queries)))
        tables = [_runs_of(r) if q is True else None for r, q in zip(rules, queries)]
        base = {r.kind for r in BASE_RULES}
        for batch in batches:
            counts, shas, spans = [], [], []
            for _, _, raw, at in bv.text_runs(batch.column(1)):
                n = len(at) - 1
                postings = index.postings(raw, at)
                found: dict[int, list[tuple[int, int, int]]] = {}
                texts: dict[int, str] = {}
                for k, (rule, query) in enumerate(zip(rules, queries)):
                    if tables[k] is not None:
                        # No mandatory trigram: every byte is scanned, for runs that are long enough.
                        starts, ends, owner = bv.word_spans(raw, at, tables[k])
                        candidates = np.unique(owner[ends - starts >= max(rule.least, 1)])
                    else:
                        candidates = index.answer(query, postings, n)
                    for t in candidates.tolist():
                        if t not in texts:
                            texts[t] = raw[at[t] : at[t + 1]].tobytes().decode()
                        for s, e in find(rule, compiled[k], texts[t]):
                            found.setdefault(t, []).append((s, k, e))
                for t in range(n):
                    every = sorted(found.get(t, []))
                    counts.append([sum(k == j for _, k, _ in every) for j in range(len(BASE_RULES))])
                    named = [(rules[k].kind, f"{rules[k].kind}:{s}:{e}") for s, k, e in every]
                    shas.append(hashlib.sha256(",".join(x for kind, x in named if kind in base).encode()).hexdigest())
                    spans.append(",".join(x for _, x in named))
            table = np.array(counts, np.int64).reshape(-1, len(BASE_RULES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, j]) for j in range(len(BASE_RULES))), pa.array(shas, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points (end exclusive), by start, then in the order of the rules, joined by
    commas; base_sha256 is the digest of the base rules' spans alone. docs needs doc_id and text; other columns
    are ignored. A null text is empty and holds nothing; rows that repeat are scanned each.
    """
    arrow_limits(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(_scan_rows(RULES)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
