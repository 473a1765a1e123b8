"""Secret scans by one automaton for all rules.

Rule regexes are parsed, joined into one nondeterministic automaton whose start state loops,
turned deterministic by subset construction over classes of bytes that all rules treat alike, and
minimised by partition refinement. One pass over the UTF-8 bytes of a text then finds, for every
rule at once, where matches end; a match's start comes from the same construction on the reversed
rule, its full length from the rule's own automaton. Both of these run only where a match ends.

Matches of a rule are leftmost, longest and don't overlap, for rules in which a match that starts
earlier also ends earlier (all rules here). Spans are code points, end exclusive.

Defined results: null text is empty and has no spans; null or repeated doc_ids keep a row each; an
empty table gives an empty frame; matches of different rules may overlap and are all returned; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_col


@dataclass(frozen=True)
class Rule:
    """A kind of secret: `pattern` over ASCII, letters in either case if `fold`; a match is kept if it has `least` characters and `tail` of `last` end it."""

    kind: str
    pattern: str
    fold: bool = False
    last: str = ""
    tail: int = 0
    least: int = 0


# The base rules, their order and least lengths. A run of characters has its least
# length in the pattern where a shorter run can hold no other match.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, "A-Za-z0-9+/_.=-", 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)

# Published forms of credentials that the base rules don't cover. Least lengths counted in
# the pattern, and rules of several runs, would multiply the states of the combined automaton (six more
# rules made 78,204), so lengths are checked on the match and rules are few.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", r"gh[oprsu]_[A-Za-z0-9]+", least=40),
    Rule("pay_key", r"[rs]k_live_[A-Za-z0-9]+", least=24),
)


class _Reader:
    """Recursive descent over: literals, \\xHH and \\c escapes, classes, groups, |, ?, *, +, {m}, {m,}, {m,n}."""

    def __init__(self, pattern: str, fold: bool):
        self.s, self.i, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def either(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("then", parts)

    def repeated(self):
        x = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.s.index("}", self.i)
                low, _, high = self.s[self.i : end].partition(",")
                least, most = int(low), (int(high) if high else None if "," in self.s[self.i : end] else int(low))
                self.i = end + 1
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            x = ("times", x, least, most)
        return x

    def char(self) -> int:
        c = self.peek()
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.peek()
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def atom(self):
        if self.peek() == "(":
            self.i += 1
            x = self.either()
            self.i += 1
            return x
        if self.peek() == "[":
            self.i += 1
            return ("set", self.folded(self.members()))
        return ("set", self.folded({self.char()}))

    def members(self) -> set[int]:
        found: set[int] = set()
        while self.peek() != "]":
            low = self.char()
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                found |= set(range(low, self.char() + 1))
            else:
                found.add(low)
        self.i += 1
        return found

    def folded(self, chars: set[int]) -> frozenset[int]:
        if self.fold:
            chars = chars | {ord(chr(c).swapcase()) for c in chars if chr(c).isalpha()}
        return frozenset(chars)


def _mirrored(x):
    if x[0] == "set":
        return x
    if x[0] == "times":
        return ("times", _mirrored(x[1]), *x[2:])
    parts = [_mirrored(p) for p in x[1]]
    return (x[0], parts[::-1] if x[0] == "then" else parts)


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.by: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.by.append(None)
        return len(self.free) - 1

    def add(self, x, at: int) -> int:
        """States for x from `at`; returns where it ends."""
        if x[0] == "set":
            end = self.state()
            step = self.state()
            self.free[at].append(step)
            self.by[step] = (x[1], end)
            return end
        if x[0] == "then":
            for p in x[1]:
                at = self.add(p, at)
            return at
        if x[0] == "or":
            end = self.state()
            for p in x[1]:
                self.free[self.add(p, at)].append(end)
            return end
        _, part, least, most = x
        for _ in range(least):
            at = self.add(part, at)
        if most is None:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.add(part, loop)].append(loop)
            return loop
        end = self.state()
        self.free[at].append(end)
        for _ in range(most - least):
            at = self.add(part, at)
            self.free[at].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


def automaton(parsed: list, anywhere: bool) -> tuple[np.ndarray, np.ndarray]:
    """(transitions [state, byte], accepted rules of a state as bits) for parsed rules; state 0 starts, -1 is no match left.

    anywhere: a match may start at any byte.
    """
    nfa = _Nfa()
    start = nfa.state()
    ends = [nfa.add(x, start) for x in parsed]
    # sets of states are integers with a bit for each state
    mask = lambda states: sum(1 << s for s in nfa.closure(states))
    first = mask([start])
    keep = first if anywhere else 0
    # bytes that no rule tells apart share a column
    marks = np.zeros(256, dtype=object)
    for k, (chars, _) in enumerate(b for b in nfa.by if b):
        for c in chars:
            marks[c] |= 1 << k
    columns: dict[int, int] = {}
    of_byte = np.array([columns.setdefault(m, len(columns)) for m in marks])
    sample = [int(np.flatnonzero(of_byte == k)[0]) for k in range(len(columns))]
    moves = []  # of each state: the columns it leaves by, and where to
    for b in nfa.by:
        to = mask([b[1]]) if b else 0
        moves.append([(k, to) for k, c in enumerate(sample) if b and c in b[0]])
    place, todo, rows = {first: 0}, [first], []
    while len(rows) < len(todo):
        now, after = todo[len(rows)], [keep] * len(sample)
        while now:
            low = now & -now
            for k, to in moves[low.bit_length() - 1]:
                after[k] |= to
            now ^= low
        for a in after:
            if a and a not in place:
                place[a] = len(place)
                todo.append(a)
        rows.append([place[a] if a else -1 for a in after])
    step = np.array(rows)
    accept = np.array([sum(1 << k for k, e in enumerate(ends) if s >> e & 1) for s in todo])
    # minimise: split classes until every transition of a class leads to one class
    group = np.unique(accept, return_inverse=True)[1]
    while True:
        signature = np.column_stack([group, np.where(step < 0, -1, group[step])]).astype(np.int32)
        names: dict[bytes, int] = {}
        finer = np.array([names.setdefault(row.tobytes(), len(names)) for row in signature])
        if finer.max() == group.max():
            break
        group = finer
    order = np.argsort(np.unique(group, return_index=True)[1])  # classes by their first state: the start's class is 0
    name = np.empty_like(order)
    name[order] = np.arange(len(order))
    group = name[group]
    table = np.full((len(order), 256), -1)
    table[group] = np.where(step < 0, -1, group[step])[:, of_byte]
    bits = np.zeros(len(order), int)
    bits[group] = accept
    return table, bits


@dataclass
class Scanner:
    """Arrays of the combined automaton, and of each rule's own, forwards and reversed."""

    rules: tuple[Rule, ...]
    every: tuple[np.ndarray, np.ndarray]
    own: list[tuple[np.ndarray, np.ndarray]]
    back: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def compile(cls, rules: tuple[Rule, ...] = BASE) -> Scanner:
        parsed = [_Reader(r.pattern, r.fold).either() for r in rules]
        return cls(tuple(rules), automaton(parsed, True), [automaton([x], False) for x in parsed], [automaton([_mirrored(x)], False) for x in parsed])

    def rows(self) -> list:
        """Linked rows: row[byte] is the next row, row[256] the rules that end there."""
        table, bits = self.every
        linked = [[None] * 257 for _ in table]
        for row, to, b in zip(linked, table.tolist(), bits.tolist(), strict=True):
            row[:256] = [linked[t] for t in to]
            row[256] = b
        return linked

    def scan(self, data: bytes, linked: list) -> dict[int, list[tuple[int, int]]]:
        """Byte spans of each rule's matches."""
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        done = [0] * len(self.rules)
        row = linked[0]
        for i, b in enumerate(data):
            row = row[b]
            if row[256]:
                for k in range(len(done)):
                    if row[256] >> k & 1 and i >= done[k]:
                        start = self._run(self.back[k], data, i, done[k] - 1, -1)
                        if start is None:
                            continue
                        end = self._run(self.own[k], data, start, len(data), 1) + 1
                        found[k].append((start, end))
                        done[k] = end
        return found

    @staticmethod
    def _run(auto: tuple[np.ndarray, np.ndarray], data: bytes, at: int, stop: int, step: int) -> int | None:
        """The last place where the automaton accepts."""
        table, bits = auto
        s, last = 0, None
        while at != stop:
            s = table[s, data[at]]
            if s < 0:
                break
            if bits[s]:
                last = at
            at += step
        return last

    def keep(self, k: int, text: str) -> bool:
        r = self.rules[k]
        return len(text) >= r.least and (not r.tail or bool(_tail(r.last, r.tail).search(text)))


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner.compile(rules)


@lru_cache(maxsize=32)
def _tail(last: str, least: int):
    import re

    # the last group starts at its separator: an optional quote after the first : or =
    return re.compile(rf"^[^:=]*[:=]\x20*[\"']?[{last}]{{{least},}}$")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and secrets, an array of (kind, start, end) in order of start, then rule, for each row of `docs` (doc_id, text)."""
    made = docs.sparkSession.sparkContext.broadcast(compiled(tuple(rules)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = made.value
        linked = scanner.rows()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            out = []
            for t in b.column(1):
                data = t.as_buffer().to_pybytes()
                spans = []
                found = scanner.scan(data, linked)
                # code points before each byte, counted once for a text
                points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1 if found and not data.isascii() else None
                for k, hits in found.items():
                    for s, e in hits:
                        if scanner.keep(k, data[s:e].decode()):
                            at = s if points is None else int(points[s])
                            spans.append((at, k, at + e - s))
                out.append([{"kind": scanner.rules[k].kind, "start": s, "end": e} for s, k, e in sorted(spans)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["doc_id", "secrets"])

    return docs.select(F.col("doc_id").cast("bigint"), text_col().alias("text")).mapInArrow(scan, "doc_id bigint, secrets array<struct<kind: string, start: bigint, end: bigint>>")


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("secrets", lambda x: x.kind.isin([r.kind for r in BASE]))
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x.kind == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))
