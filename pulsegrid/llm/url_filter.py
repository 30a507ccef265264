"""URL filters by a bit-parallel wildcard automaton.

Glob rules (``*``: any run, ``?``: one symbol) are packed side by side into the
bits of a few 64-bit words.  One bit stands for one pattern position; a shift,
an or with the start bits and an and with the mask of the read symbol move all
patterns on at once, and positions before a ``*`` keep their bit.  A batch of
urls runs in step, one symbol a time, as numpy words.

The automaton reads a canonical form of the url: ``.`` host BOUNDARY path END,
where BOUNDARY and END are symbols that no text contains.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import ascii_lower

BOUNDARY, END, SYMBOLS = 256, 257, 258


@dataclass(frozen=True)
class Rule:
    """A verdict for urls whose canonical form fits ``glob`` whole; ``weight`` ranks rules that fit together."""

    name: str
    verdict: str
    glob: tuple[int | str, ...]
    weight: int


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the path starts with ``path``."""
    glob = ("*", *b"." + host.encode(), BOUNDARY, *path.encode(), "*")
    return Rule(host + path, verdict, glob, len(host + path))


def glob_rule(verdict: str, host: str, path: str = "*") -> Rule:
    """A rule of the method's own list: globs over ``.host`` and path; weight 0, so host rules win."""

    def symbols(text: str) -> list[int | str]:
        return [c if c in "*?" else ord(c) for c in text]

    return Rule(f"{host} {path}", verdict, (*symbols(host), BOUNDARY, *symbols(path), END), 0)


#: Rules named by the contract: verdict, host, path.
BASE_RULES = (
    host_rule("block", "net", "/"),
    host_rule("allow", "example.net", "/en/"),
    host_rule("block", "example.com", "/de/"),
    host_rule("allow", "org", "/fr/"),
)
#: The method's own patterns: advert and tracker hosts, session and trap paths.
OWN_RULES = tuple(
    glob_rule("block", host, path)
    for host, path in (
        ("*.ads.*", "*"), ("*.adserver.*", "*"), ("*.doubleclick.*", "*"), ("*.tracking.*", "*"),
        ("*.casino*", "*"), ("*.porn*", "*"), ("*.xxx", "*"),
        ("*", "/cgi-bin/*"), ("*", "*/wp-login.php*"), ("*", "*.exe"), ("*", "*.apk"), ("*", "*/cart/checkout*"),
    )
)


class ShiftAnd:
    """All globs packed into multiword masks."""

    def __init__(self, globs: list[tuple[int | str, ...]]):
        positions: list[tuple[set[int] | None, bool]] = []  # symbols read (None: any), and whether a '*' stands before
        self.finals: list[tuple[int, bool]] = []
        starts, loops = [], []
        self.always: list[bool] = []
        for glob in globs:
            star, first = False, len(positions)
            for symbol in glob:
                if symbol == "*":
                    star = True
                    continue
                positions.append((None if symbol == "?" else {symbol}, star))
                star = False
            self.always.append(first == len(positions) and star)
            if first < len(positions):
                starts.append(first)
            self.finals.append((len(positions) - 1 if first < len(positions) else -1, star))
        for k, (_, star) in enumerate(positions):
            if star:
                loops.append(k)
        self.words = max(1, (len(positions) + 63) // 64)
        # bit k set: the pattern has read up to, but not with, position k
        self.start = self._bits(starts)
        self.loop = self._bits(loops)
        self.mask = np.zeros((SYMBOLS, self.words), np.uint64)
        for k, (symbols, _) in enumerate(positions):
            for s in range(SYMBOLS) if symbols is None else symbols:
                if symbols is None and s in (BOUNDARY, END):
                    continue
                self.mask[s, k // 64] |= np.uint64(1 << (k % 64))
        self.keeps_end = self._bits([f for f, star in self.finals if star and f >= 0])
        self.last = self._bits([f for f, _ in self.finals if f >= 0])

    def _bits(self, positions: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for k in positions:
            out[k // 64] |= np.uint64(1 << (k % 64))
        return out

    def run(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, globs): which globs fit which symbol sequences whole."""
        n = len(texts)
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order])
        wide = int(lengths[0]) if n else 0
        live = np.broadcast_to(self.start, (n, self.words)).copy()  # positions ready to read
        done = np.zeros((n, self.words), np.uint64)  # last positions read just now, or before under a final '*'
        one = np.uint64(1)
        for t in range(wide):
            m = int(np.searchsorted(-lengths, -t, side="left"))  # texts longer than t
            symbol = np.fromiter((texts[order[i]][t] for i in range(m)), np.int64, m)
            hit = live[:m] & self.mask[symbol]
            done[:m] = (done[:m] & self.keeps_end) | (hit & self.last)
            moved = hit & ~self.last
            ahead = moved << one
            if self.words > 1:
                ahead[:, 1:] |= moved[:, :-1] >> np.uint64(63)
            live[:m] = ahead | (live[:m] & self.loop)
        out = np.zeros((n, len(self.finals)), bool)
        for g, (final, _) in enumerate(self.finals):
            if final >= 0:
                out[order, g] = (done[:, final // 64] >> np.uint64(final % 64)) & one == 1
            else:
                out[:, g] = self.always[g] or lengths[np.argsort(order)] == 0
        return out


def canonical(host: str | None, path: str | None) -> np.ndarray:
    h, p = (host or "").encode(), (path or "").encode()
    out = np.empty(len(h) + len(p) + 3, np.int16)
    out[0] = ord(".")
    out[1 : len(h) + 1] = np.frombuffer(h, np.uint8)
    out[len(h) + 1] = BOUNDARY
    out[len(h) + 2 : -1] = np.frombuffer(p, np.uint8)
    out[-1] = END
    return out


def filter_urls(
    pages: DataFrame,
    rules: tuple[Rule, ...] = BASE_RULES + OWN_RULES,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Host, path, deciding rule and verdict of every url; one row per input row.

    A null url, or one without ``://``, has an empty host and path and gets the
    default verdict.  Of several fitting rules the one with the largest weight
    (longest host rule) decides, then block before allow, then the first.  Rules
    of weight 0 are the method's own and leave ``rule`` null.  Repeated rows stay.
    """
    split = F.regexp_extract(F.col(url_col), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    rest = F.regexp_extract(F.col(url_col), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    base = pages.select(
        F.col(id_col).alias("page_id"),
        F.coalesce(ascii_lower(split), F.lit("")).alias("host"),
        F.coalesce(rest, F.lit("")).alias("path"),
    )
    order = sorted(rules, key=lambda r: (-r.weight, r.verdict != "block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd([r.glob for r in order])
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                texts = [canonical(h, p) for h, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                fits = automaton.run(texts)
                first = np.where(fits.any(axis=1), fits.argmax(axis=1), -1)
                won = [order[k] if k >= 0 else None for k in first]
                names = [r.name if r and r.weight else None for r in won]
                verdicts = [r.verdict if r else default for r in won]
                columns = [*part.columns, pa.array(names, pa.string()), pa.array(verdicts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "host", "path", "rule", "verdict"])

    return base.mapInArrow(run, f"page_id {base.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
