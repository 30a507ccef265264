"""Edit-aware token counts: a segment tree over a document's pre-tokens.

Every document gets its tree.  A leaf is one pre-token, every node holds the
characters and tokens below it, and the root the document's count.  An edit
finds its leaves by character offset, cuts the touched leaves and enough
neighbours anew that the cut falls into step again, encodes the pre-tokens that
are new and updates the sums on the way up.  Where an edit leaves more
pre-tokens than leaves, the last of them holds several; at CROWDED of them the
tree is laid out anew.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.pretoken import PretokenEncoder, cut, encoder

#: Leaves taken along on each side of an edit before the cut is compared.
CONTEXT = 2
#: Pre-tokens in one leaf from which on a tree is laid out anew.
CROWDED = 16
#: Redactions counted by the registered query: mail addresses and dotted IPv4 numbers.
REDACTIONS = (
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), "<email>"),
    (re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), "<ip>"),
)


class PretokenTree:
    def __init__(self, text: str, enc: PretokenEncoder):
        self.enc = enc
        self.encoded = 0  # pre-tokens encoded again since the start
        parts = cut(text)
        enc.learn(set(parts))
        self._lay_out(parts, list(map(enc.cache.__getitem__, parts)))

    def _lay_out(self, parts: list[str], counts: list[int]) -> None:
        n = len(parts)
        self.leaves, self.counts = [(p,) for p in parts], [(c,) for c in counts]
        self.width = 1 << (max(1, n) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        self.chars[self.width : self.width + n] = list(map(len, parts))
        self.tokens[self.width : self.width + n] = counts
        level = self.width
        while level > 1:
            for sums in (self.chars, self.tokens):
                np.add(sums[level : 2 * level : 2], sums[level + 1 : 2 * level : 2], out=sums[level // 2 : level])
            level //= 2

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    @property
    def pretokens(self) -> list[str]:
        return [p for leaf in self.leaves for p in leaf]

    @property
    def text(self) -> str:
        return "".join(self.pretokens)

    def _find(self, offset: int) -> tuple[int, int]:
        """(leaf, offset in it) of the character at ``offset``."""
        at = 1
        while at < self.width:
            at *= 2
            if offset >= self.chars[at]:
                offset -= int(self.chars[at])
                at += 1
        return at - self.width, offset

    def _set(self, leaf: int, parts: tuple[str, ...], counts: tuple[int, ...]) -> None:
        self.leaves[leaf], self.counts[leaf] = parts, counts
        at = leaf + self.width
        dc, dt = sum(map(len, parts)) - int(self.chars[at]), sum(counts) - int(self.tokens[at])
        while at:
            self.chars[at] += dc
            self.tokens[at] += dt
            at >>= 1

    def _joined(self, a: int, b: int) -> str:
        return "".join(p for leaf in self.leaves[a:b] for p in leaf)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters ``start`` to ``end`` (exclusive) of the current text."""
        size = int(self.chars[1])
        start, end = max(0, min(start, size)), max(0, min(end, size))
        if not self.leaves:
            self.leaves, self.counts = [()], [()]
        last = len(self.leaves) - 1
        low = self._find(start)[0] if start < size else last
        high = self._find(end - 1)[0] if end > start else low
        high = max(low, min(high, last))
        pad = CONTEXT
        while True:
            a, b = self._back(low, pad), self._ahead(high, pad, last)
            base = self._offset(a)
            old = self._joined(a, b + 1)
            text = old[: start - base] + new + old[end - base :]
            # the cut is right if more text on each side leaves it as it is
            x, y = self._back(a, CONTEXT), self._ahead(b, CONTEXT, last)
            before, after = self._joined(x, a), self._joined(b + 1, y + 1)
            inner, at, cuts = [], 0, set()
            for p in cut(before + text + after):
                cuts.add(at)
                if len(before) <= at < len(before) + len(text):
                    inner.append(p)
                at += len(p)
            cuts.add(at)
            if len(before) in cuts and len(before) + len(text) in cuts or a == 0 and b == last:
                break
            pad *= 2
        self._replace(a, b, inner)

    def _replace(self, a: int, b: int, parts: list[str]) -> None:
        """Put the pre-tokens into the leaves from ``a`` to ``b``; what they begin and end with already keeps its counts."""
        old = [p for leaf in self.leaves[a : b + 1] for p in leaf]
        known = [c for leaf in self.counts[a : b + 1] for c in leaf]
        same = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        head = same(old, parts)
        tail = same(old[head:][::-1], parts[head:][::-1])
        new = parts[head : len(parts) - tail]
        self.enc.learn(set(new))
        self.encoded += len(new)
        counts = known[:head] + [self.enc.cache[p] for p in new] + known[len(known) - tail :]
        slots = b - a + 1
        if len(parts) - slots >= CROWDED:
            flat, told = self.pretokens, [c for leaf in self.counts for c in leaf]
            first = sum(map(len, self.leaves[:a]))
            self._lay_out(flat[:first] + parts + flat[first + len(old) :], told[:first] + counts + told[first + len(old) :])
            return
        for i in range(slots):
            to = i + 1 if i < slots - 1 else len(parts)
            if self.leaves[a + i] != tuple(parts[i:to]):
                self._set(a + i, tuple(parts[i:to]), tuple(counts[i:to]))

    def _offset(self, leaf: int) -> int:
        at, out = leaf + self.width, 0
        while at > 1:
            if at & 1:
                out += int(self.chars[at - 1])
            at >>= 1
        return out

    def _back(self, leaf: int, steps: int) -> int:
        """``steps`` non-empty leaves earlier."""
        while leaf > 0 and steps:
            leaf -= 1
            steps -= bool(self.leaves[leaf])
        return leaf

    def _ahead(self, leaf: int, steps: int, last: int) -> int:
        while leaf < last and steps:
            leaf += 1
            steps -= bool(self.leaves[leaf])
        return leaf


def redactions(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), mark) for rule, mark in REDACTIONS for m in rule.finditer(text)]
    out: list[tuple[int, int, str]] = []
    for s, e, mark in sorted(found):
        if not out or s >= out[-1][1]:
            out.append((s, e, mark))
    return out


def count_tokens(
    docs: DataFrame, tokenizer_path: str, edits: Callable[[str], list[tuple[int, int, str]]] = redactions,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_tokens, n_edits, n_tokens_after, n_pretokens, n_reencoded``: one row per input row.

    ``edits(text)`` gives non-overlapping (start, end, replacement) by start, in
    offsets of the original text.  ``n_pretokens`` are those after the edits,
    ``n_reencoded`` those that the edits had encoded.  Null and empty texts have
    no tokens.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for text in part.column(1).to_pylist():
                    tree = PretokenTree(text or "", enc)
                    before, todo = tree.total, edits(text) if text else []
                    for s, e, new in reversed(todo):
                        tree.edit(s, e, new)
                    rows.append((before, len(todo), tree.total, sum(map(len, tree.leaves)), tree.encoded))
                columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *columns], ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_pretokens", "n_reencoded"]
                )

    return plain.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_edits long, n_tokens_after long, n_pretokens long, n_reencoded long")
