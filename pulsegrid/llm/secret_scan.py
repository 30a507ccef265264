"""Secret scans by one deterministic automaton over bytes.

The rules' regexes become one NFA, subset construction makes it deterministic
and partition refinement makes it minimal.  Rows of the transition table are
Python lists that point at each other, so reading a byte is one index.  A first
pass over a text only asks whether it ever accepts; texts that do are read
again with the accepting ends noted, and a second automaton of the reversed
rules, read backwards from each end, gives the leftmost start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import byte_texts


@dataclass(frozen=True)
class SecretRule:
    """``regex`` in the small syntax of :func:`parse`; ``least`` bytes needed in the part after ``tail_of``."""

    kind: str
    regex: str
    least: int
    nocase: bool = False  # letters of the literals fit in either case
    value: bytes | None = None  # bytes that make up the trailing value, where only that is measured


_VALUE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: The three base rules, then the method's own.  Keyword letters of `assign` fit in either case.
RULES = (
    SecretRule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", 6, True, _VALUE),
    SecretRule("access", r"AKIA[A-Z0-9]+", 20),
    SecretRule("hex", r"[0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f][0-9a-f]+", 24),
    SecretRule("github", r"gh[opsu]_[A-Za-z0-9]+", 40),
    SecretRule("google", r"AIza[A-Za-z0-9_\-]+", 39),
    SecretRule("slack", r"xox[abps]-[A-Za-z0-9\-]+", 20),
    SecretRule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 20),
)
BASE = 3


# ---- regex to NFA: nodes are ("set", bytes), ("cat", [...]), ("alt", [...]), ("rep", node, least, unbounded)
def parse(regex: str, nocase: bool):
    """Literals, ``\\x..`` and ``\\c`` escapes, classes, groups, ``|``, ``?``, ``*`` and ``+``."""
    at = 0

    def letter(b: int) -> frozenset[int]:
        c = chr(b)
        return frozenset({b, ord(c.swapcase())}) if nocase and c.isalpha() else frozenset({b})

    def char() -> int:
        nonlocal at
        c = regex[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = regex[at]
        at += 1
        if c == "x":
            at += 2
            return int(regex[at - 2 : at], 16)
        return ord(c)

    def alternation():
        nonlocal at
        ways = [sequence()]
        while at < len(regex) and regex[at] == "|":
            at += 1
            ways.append(sequence())
        return ("alt", ways)

    def sequence():
        nonlocal at
        parts = []
        while at < len(regex) and regex[at] not in "|)":
            if regex[at] == "(":
                at += 1
                node = alternation()
                at += 1
            elif regex[at] == "[":
                at += 1
                chosen: set[int] = set()
                while regex[at] != "]":
                    low = char()
                    if regex[at] == "-" and regex[at + 1] != "]":
                        at += 1
                        chosen |= set(range(low, char() + 1))
                    else:
                        chosen.add(low)
                at += 1
                node = ("set", frozenset(chosen))
            else:
                node = ("set", letter(char()))
            if at < len(regex) and regex[at] in "?*+":
                sign = regex[at]
                at += 1
                node = ("rep", node, sign == "+", sign != "?")
            parts.append(node)
        return ("cat", parts)

    return alternation()


def reverse(node):
    if node[0] == "set":
        return node
    if node[0] == "cat":
        return ("cat", [reverse(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [reverse(x) for x in node[1]])
    return ("rep", reverse(node[1]), node[2], node[3])


class Automaton:
    """Minimal DFA of several rules; ``rows[s][b]`` is the next row, ``rows[s][256]`` the accepted rules as bits."""

    def __init__(self, nodes: list, anchored: bool):
        self._empty: list[set[int]] = []
        self._moves: list[list[tuple[frozenset[int], int]]] = []
        first = self._state()
        accepts = {}
        for k, node in enumerate(nodes):
            begin, end = self._build(node)
            self._empty[first].add(begin)
            accepts[end] = 1 << k
        table, marks = self._determine(first, accepts, anchored)
        self.rows, self.start = self._minimise(table, marks)

    def _state(self) -> int:
        self._empty.append(set())
        self._moves.append([])
        return len(self._empty) - 1

    def _build(self, node) -> tuple[int, int]:
        a, b = self._state(), self._state()
        if node[0] == "set":
            self._moves[a].append((node[1], b))
        elif node[0] == "cat":
            last = a
            for x in node[1]:
                s, e = self._build(x)
                self._empty[last].add(s)
                last = e
            self._empty[last].add(b)
        elif node[0] == "alt":
            for x in node[1]:
                s, e = self._build(x)
                self._empty[a].add(s)
                self._empty[e].add(b)
        else:
            s, e = self._build(node[1])
            self._empty[a].add(s)
            self._empty[e].add(b)
            if not node[2]:
                self._empty[a].add(b)
            if node[3]:
                self._empty[e].add(s)
        return a, b

    def _closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self._empty[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def _determine(self, first, accepts, anchored):
        origin = self._closure([first])
        index, table, marks, todo = {origin: 0}, [], [], [origin]
        while todo:
            subset = todo.pop(0)
            row_sets: list[set[int]] = [set() for _ in range(256)]
            for s in subset if anchored else subset | origin:
                for chosen, target in self._moves[s]:
                    for b in chosen:
                        row_sets[b].add(target)
            row = []
            memo: dict[frozenset[int], int] = {}
            for targets in row_sets:
                key = frozenset(targets)
                if key not in memo:
                    nxt = self._closure(key if anchored else key | {first})
                    if nxt not in index:
                        index[nxt] = len(index)
                        todo.append(nxt)
                    memo[key] = index[nxt]
                row.append(memo[key])
            table.append(row)
            marks.append(sum({accepts[s] for s in subset if s in accepts}))
        return table, marks

    @staticmethod
    def _minimise(table, marks):
        block = list(marks)
        while True:
            seen: dict[tuple, int] = {}
            new = [seen.setdefault((block[s], *[block[t] for t in table[s]]), len(seen)) for s in range(len(table))]
            if len(seen) == len(set(block)):
                break
            block = new
        rows: dict[int, list] = {k: [None] * 257 for k in set(new)}
        for s, k in enumerate(new):
            rows[k][:256] = [rows[new[t]] for t in table[s]]
            rows[k][256] = marks[s]
        return list(rows.values()), rows[new[0]]

    def absorbing(self) -> tuple[list, list]:
        """(start, sink): the same automaton with every accepting state turned into one sink."""
        sink: list = [None] * 256
        sink[:] = [sink] * 256
        copies = {id(r): sink if r[256] else [None] * 256 for r in self.rows}
        for r in self.rows:
            if not r[256]:
                copies[id(r)][:] = [copies[id(t)] for t in r[:256]]
        return copies[id(self.start)], sink


class SecretScanner:
    def __init__(self, rules: tuple[SecretRule, ...] = RULES):
        self.rules = rules
        nodes = [parse(r.regex, r.nocase) for r in rules]
        self.forward = Automaton(nodes, anchored=False)
        self.backward = [Automaton([reverse(n)], anchored=True) for n in nodes]
        self.begin, self.sink = self.forward.absorbing()

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes, leftmost and non-overlapping within each rule, by start then rule."""
        row = self.begin
        for b in data:
            row = row[b]
        if row is not self.sink:
            return []
        ends: list[tuple[int, int]] = []
        row, before = self.forward.start, 0
        for at, b in enumerate(data):
            row = row[b]
            now = row[256]
            if before & ~now:
                ends.append((at, before & ~now))
            before = now
        if before:
            ends.append((len(data), before))
        found, last = [], [0] * len(self.rules)
        for end, bits in ends:
            for k, rule in enumerate(self.rules):
                if bits >> k & 1:
                    start, row = -1, self.backward[k].start
                    for at in range(end - 1, last[k] - 1, -1):
                        row = row[data[at]]
                        if row[256]:
                            start = at
                        if row is row[0] and not row[256]:
                            break  # a dead state leads to itself only
                    if start < 0:
                        continue
                    last[k] = end
                    if self._size(rule, data[start:end]) >= rule.least:
                        found.append((k, start, end))
        return sorted(found, key=lambda x: (x[1], x[0]))

    @staticmethod
    def _size(rule: SecretRule, match: bytes) -> int:
        if rule.value is None:
            return len(match)
        # the value follows the separator, blanks and a quote
        at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
        rest = match[at:].lstrip(b" ")
        return len(rest[1:] if rest[:1] in (b'"', b"'") else rest)


_scanner: dict[tuple, SecretScanner] = {}


def scan_secrets(
    docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, found array<struct<kind, start, end>>``: spans in code points, end exclusive, one row per input row.

    Null and empty texts have none.  Texts are scanned whole.  Order: by start,
    then by the rule's place.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner.get(rules) or _scanner.setdefault(rules, SecretScanner(rules))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for data in byte_texts(batch.column(1)):
                spans = scanner.spans(data) if data else []
                if spans and not data.isascii():
                    # code points begin at every byte that does not continue one
                    begun = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
                    before = np.concatenate([[0], np.cumsum(begun)])
                    spans = [(k, int(before[s]), int(before[e])) for k, s, e in spans]
                out.append([{"kind": rules[k].kind, "start": s, "end": e} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "found"])

    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, found array<struct<kind:string,start:long,end:long>>")
