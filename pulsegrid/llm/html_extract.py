"""Main text of pages by a recurrent block labeller in numpy.

A page is a sequence of leaf blocks.  Each block becomes a vector: the mean of
hashed vectors of its tag path (tags, classes, ids), the mean of hashed vectors
of its words, and a few sizes.  A bidirectional LSTM reads the whole sequence,
so every block is labelled in the light of all others, and blocks labelled as
main text are joined.  The model is trained from made pages (see
:mod:`pulsegrid.llm.html_training`): TRAIN_PAGES bounds the sample, the seed is
fixed, and no page of the corpus is used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.html_blocks import Block, blocks
from pulsegrid.llm.html_training import PageMaker

TRAIN_PAGES, EPOCHS, SEED = 3000, 6, 7
PATH_ROWS, PATH_SIZE, WORD_ROWS, WORD_SIZE, SIZES, HIDDEN = 2048, 14, 1024, 6, 5, 20
INPUT = PATH_SIZE + WORD_SIZE + SIZES
#: Pages labelled in one numpy pass.
PASS = 128

Weights = dict[str, np.ndarray]


def _features(pages: list[list[Block]]):
    """Hashed rows with their owners, and sizes, over all blocks of the pages in a row."""
    paths, path_of, words, word_of, sizes = [], [], [], [], []
    crc = zlib.crc32
    k = 0
    for page in pages:
        for block in page:
            marks = [crc(m.encode()) % PATH_ROWS for m in block.path]
            marks.append(crc(("last " + next((m for m in reversed(block.path) if m[0] not in ".@"), "")).encode()) % PATH_ROWS)
            paths += marks
            path_of += [k] * len(marks)
            found = [crc(w) % WORD_ROWS for w in block.text.lower().encode().split()]
            words += found
            word_of.append(len(found))
            n = len(block.text)
            sizes.append((np.log1p(len(found)) / 4, min(1.0, block.linked / n), n / (5 * len(found)) / 2, block.text[-1] in ".!?", len(block.path) / 10))
            k += 1
    word_of = np.repeat(np.arange(k), word_of)
    return np.array(paths), np.array(path_of), np.array(words), word_of, np.array(sizes, np.float32).reshape(k, SIZES)


def _means(table: np.ndarray, rows: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(owner, minlength=n).astype(np.float32)[:, None]
    first = np.searchsorted(owner, np.arange(n))
    out = np.add.reduceat(table[rows], first, axis=0) if len(rows) else np.zeros((n, table.shape[1]), np.float32)
    return out / counts, counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, live: np.ndarray, w: np.ndarray, keep: bool):
    """(T, B, HIDDEN) states of inputs (T, B, INPUT); where ``live`` is 0 the state stays."""
    steps, n, _ = x.shape
    h = c = np.zeros((n, HIDDEN), np.float32)
    out, past = np.zeros((steps, n, HIDDEN), np.float32), []
    inputs = x @ w[:INPUT] + w[-1]
    for t in range(steps):
        z = inputs[t] + h @ w[INPUT:-1]
        i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = live[t][:, None]
        new = f * c + i * g
        tanh = np.tanh(new)
        if keep:
            past.append((h, c, i, f, o, g, tanh))
        c = m * new + (1 - m) * c
        h = m * (o * tanh) + (1 - m) * h
        out[t] = h
    return out, past


def _lstm_back(x, live, w, past, grad):
    steps, n, _ = x.shape
    dw, dx = np.zeros_like(w), np.zeros_like(x)
    dh = dc = np.zeros((n, HIDDEN), np.float32)
    for t in reversed(range(steps)):
        h, c, i, f, o, g, tanh = past[t]
        m = live[t][:, None]
        dh = dh + grad[t]
        dn = dh * m
        dnew = dc * m + dn * o * (1 - tanh**2)
        dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), dn * tanh * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
        dw[:INPUT] += x[t].T @ dz
        dw[INPUT:-1] += h.T @ dz
        dw[-1] += dz.sum(axis=0)
        dx[t] = dz @ w[:INPUT].T
        dh = dh * (1 - m) + dz @ w[INPUT:-1].T
        dc = dc * (1 - m) + dnew * f
    return dw, dx


class _Batch:
    """Pages side by side, padded at the end."""

    def __init__(self, pages: list[list[Block]]):
        self.lengths = [len(p) for p in pages]
        steps, n = max(self.lengths), len(pages)
        self.at = np.concatenate([np.arange(k) * n + b for b, k in enumerate(self.lengths)])  # flat (t, b) of each block
        self.back = np.concatenate([np.arange(k)[::-1] * n + b for b, k in enumerate(self.lengths)])
        self.shape = (steps, n)
        self.live = np.zeros(steps * n, np.float32)
        self.live[self.at] = 1
        self.live = self.live.reshape(self.shape)
        self.features = _features(pages)

    def spread(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0] * self.shape[1], x.shape[1]), np.float32)
        out[at] = x
        return out.reshape(*self.shape, x.shape[1])


def _forward(w: Weights, batch: _Batch, keep: bool = False):
    paths, path_of, words, word_of, sizes = batch.features
    n = len(sizes)
    p, pn = _means(w["path"], paths, path_of, n)
    v, vn = _means(w["word"], words, word_of, n)
    x = np.concatenate([p, v, sizes], axis=1)
    xs = [batch.spread(x, batch.at), batch.spread(x, batch.back)]
    runs = [_lstm(xs[k], batch.live, w[side], keep) for k, side in enumerate(("ahead", "behind"))]
    hidden = np.concatenate([runs[0][0].reshape(-1, HIDDEN)[batch.at], runs[1][0].reshape(-1, HIDDEN)[batch.back], x], axis=1)
    score = hidden @ w["out"][:-1] + w["out"][-1]
    return score[:, 0], (hidden, xs, runs, pn, vn)


def label(w: Weights, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page the main-text flag of every block."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        # no more padded blocks in a pass than PASS pages of 64 have
        wide = max(1, min(PASS, PASS * 64 // len(pages[order[min(at + PASS, len(order)) - 1]])))
        chosen = order[at : at + wide]
        score, _ = _forward(w, _Batch([pages[i] for i in chosen]))
        begin = 0
        for i in chosen:
            out[i] = score[begin : begin + len(pages[i])] > 0
            begin += len(pages[i])
        at += wide
    return out


@lru_cache(2)
def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Weights:
    """Fit on ``pages`` made pages by Adam over back-propagated block losses; some twenty seconds on the driver, once a session, the same every time."""
    rng = np.random.default_rng(seed)
    w: Weights = {
        "path": rng.normal(0, 0.3, (PATH_ROWS, PATH_SIZE)).astype(np.float32),
        "word": rng.normal(0, 0.05, (WORD_ROWS, WORD_SIZE)).astype(np.float32),
        "ahead": rng.normal(0, 0.2, (INPUT + HIDDEN + 1, 4 * HIDDEN)).astype(np.float32),
        "behind": rng.normal(0, 0.2, (INPUT + HIDDEN + 1, 4 * HIDDEN)).astype(np.float32),
        "out": rng.normal(0, 0.2, (2 * HIDDEN + INPUT + 1, 1)).astype(np.float32),
    }
    data = []
    for k in range(pages):
        page, main = PageMaker(seed * 100_003 + k).page()
        found = blocks(page)
        if found:
            data.append((found, true_labels(found, main)))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        # pages of like length side by side, so that few steps are padding
        near = [np.array(sorted(order[at : at + 240], key=lambda i: len(data[i][0]))) for at in range(0, len(order), 240)]
        groups = [part[at : at + 24] for part in near for at in range(0, len(part), 24)]
        for group in rng.permutation(len(groups)):
            step += 1
            chosen = [data[i] for i in groups[group]]
            batch = _Batch([c[0] for c in chosen])
            y = np.concatenate([c[1] for c in chosen]).astype(np.float32)
            grads = _gradients(w, batch, y)
            rate = 0.012 * (1 - step / (1 + epochs * len(groups))) + 0.0005
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    # a name or word that no page of the training has says nothing
    paths, _, words, _, _ = _features([found for found, _ in data])
    for name, seen in (("path", paths), ("word", words)):
        fresh = np.ones(len(w[name]), bool)
        fresh[seen] = False
        w[name][fresh] = 0
    return w


def true_labels(found: list[Block], main: list[str]) -> np.ndarray:
    """Which blocks are the main texts, matched in page order."""
    import html

    wanted = [" ".join(html.unescape(m).split()) for m in main]
    out, at = np.zeros(len(found), bool), 0
    for i, block in enumerate(found):
        if at < len(wanted) and block.text == wanted[at]:
            out[i] = True
            at += 1
    return out


def _gradients(w: Weights, batch: _Batch, y: np.ndarray) -> Weights:
    score, (hidden, xs, runs, pn, vn) = _forward(w, batch, keep=True)
    paths, path_of, words, word_of, _ = batch.features
    d = ((_sigmoid(score) - y) / len(y))[:, None].astype(np.float32)
    dout = np.concatenate([hidden.T @ d, d.sum(axis=0, keepdims=True)])
    dh = d @ w["out"][:-1].T
    dx = dh[:, 2 * HIDDEN :].copy()
    grads: Weights = {"out": dout}
    for k, (side, at) in enumerate((("ahead", batch.at), ("behind", batch.back))):
        grad = batch.spread(dh[:, k * HIDDEN : (k + 1) * HIDDEN], at)
        grads[side], back = _lstm_back(xs[k], batch.live, w[side], runs[k][1], grad)
        dx += back.reshape(-1, INPUT)[at]
    for name, rows, owner, n, part in (("path", paths, path_of, pn, dx[:, :PATH_SIZE]), ("word", words, word_of, vn, dx[:, PATH_SIZE : PATH_SIZE + WORD_SIZE])):
        grads[name] = np.zeros_like(w[name])
        np.add.at(grads[name], rows, (part / n)[owner])
    return grads


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, ``text`` and ``n_blocks``: main blocks in page order, joined by a line feed.

    Null or blank html gives an empty text.  Pages are read whole; very long
    ones only make their own pass longer.  Other columns are ignored.
    """
    weights = pages.sparkSession.sparkContext.broadcast(train())  # some 200 KB, whatever the input
    plain = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html_col).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [blocks(x) for x in part.column(len(keep)).to_pylist()]
                texts, counts = [], []
                for page, flags in zip(found, label(w, found)):
                    texts.append("\n".join(b.text for b, f in zip(page, flags) if f))
                    counts.append(len(page))
                columns = [*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "text", "n_blocks"])

    schema = ", ".join(f"`{c}` {plain.schema[c].dataType.simpleString()}" for c in keep)
    return plain.mapInArrow(run, f"{schema}, text string, n_blocks long")
