"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of a word vector (words of the training sample that several
documents have) and the mean of its character trigrams' vectors (all words). Windows of
words overlap by half and all are scored: two recurrent directions, attention over the
window's positions, a logistic output. A document scores as its worst window. Trained in
numpy by backpropagation through time and attention, from random weights, on labels of
documents. For the first epochs any window of a document carries its label; then the
windows that the network itself finds worst do.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import gru
from millrace.llm.common import bounded, documents, fold, kind, map_batches, sampled
from millrace.session import spread

FOLDS, HELD_OUT = 5, 0
#: Runs of letters; longer ones are taken in pieces.
WORDS = re.compile(r"[^\W\d_]{1,40}")
#: Words of a window, and words from one window's start to the next's.
WIDTH, STRIDE = 24, 12
HIDDEN, EMBED = 8, 12
TRIGRAMS = 1 << 13
LANES = 4096
#: The bound of the training sample: rows per label. Their texts are whole.
SAMPLE_ROWS = 900
#: A word has a vector of its own if this many, and this share, of the sample's documents have it.
MIN_DOCS, MIN_SHARE, MAX_WORDS = 3, 0.004, 20_000
#: Epochs on windows drawn at random (so many per document), on the three worst of a toxic document, and on the worst.
DRAWN_EPOCHS, THREE_EPOCHS, WORST_EPOCHS, DRAWN = 4, 2, 10, 6
LANES_STEP, RATE = 96, 0.01
#: Documents of a label from which a fifth of all is left out of training, to calibrate on.
CALIBRATE_FROM = 40
#: Words whose gate inputs a worker remembers; the memory starts anew when it is full.
REMEMBERED = 200_000


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all words in a row, where each word's start, and how many."""
    parts = [b"^" + w.encode() + b"$" for w in words]
    data = np.frombuffer(b"".join(parts) + b"\0\0", np.uint8).astype(np.int64)
    h = ((data[:-2] * 961 + data[1:-1] * 31 + data[2:]) * 2654435761 >> 8) % TRIGRAMS
    sizes = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = np.maximum(sizes - 2, 1)
    at = np.repeat(starts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return h[at], np.concatenate([[0], np.cumsum(n)[:-1]]), n


def window_starts(n: int) -> range:
    """Starts of the overlapping windows that cover ``n`` words, at least one if n > 0."""
    return range(0, max(n - (WIDTH - STRIDE), 1), STRIDE) if n else range(0)


class Net:
    """Weights, with the forward pass for training and for scoring."""

    def __init__(self, w: dict, vocab: dict[str, int], scale: tuple[float, float] = (1.0, 0.0)):
        self.w, self.vocab, self.scale = w, vocab, scale
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)
        self.steps = None

    def __getstate__(self):
        return self.w, self.vocab, self.scale

    def __setstate__(self, state):
        self.__init__(*state)

    def vectors(self, words: list[str]) -> np.ndarray:
        h, starts, n = _trigrams(words)
        x = np.add.reduceat(self.w["chars"][h], starts, axis=0) / n[:, None].astype(np.float32)
        return x + self.w["words"][[self.vocab.get(w, 0) for w in words]]

    def ids(self, texts: list[list[str]]) -> list[list[int]]:
        """Rows of ``table`` (gate inputs of both directions) for the words of texts."""
        known, distinct = self.rows, set().union(*texts)
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            self.table, new = self.table[:0], list(distinct)
        if new:
            known |= zip(new, range(len(self.table) + 1 if not len(self.table) else len(self.table), len(self.table) + len(new) + (not len(self.table))), strict=False)
            x = self.vectors(new)
            rows = np.concatenate([x @ self.w["wf"] + self.w["bf"], x @ self.w["wb"] + self.w["bb"]], 1)
            pad = np.zeros((1, 6 * HIDDEN), np.float32)
            pad[0, :HIDDEN] = pad[0, 3 * HIDDEN : 4 * HIDDEN] = gru.KEEP
            self.table = np.concatenate([self.table if len(self.table) else pad, rows.astype(np.float32)])
        return [[known[w] for w in t] for t in texts]

    def windows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows of the texts, and each window's text."""
        ids = self.ids(texts)
        flat = np.array([i for t in ids for i in t] + [0], np.int64)
        sizes = np.array([len(t) for t in ids], np.int64)
        starts = np.cumsum(sizes) - sizes
        n = np.array([len(window_starts(int(s))) for s in sizes], np.int64)
        doc = np.repeat(np.arange(len(ids)), n)
        at = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
        lengths, first = np.minimum(sizes[doc] - at, WIDTH), starts[doc] + at
        out = np.empty(len(doc), np.float32)
        step = np.arange(WIDTH)[:, None]
        for i in range(0, len(doc), LANES):
            part = slice(i, i + LANES)
            codes = flat[np.minimum(first[part] + step, len(flat) - 1)]
            codes[step >= lengths[part]] = 0
            out[part] = self._score(codes)
        return out, doc

    def _score(self, codes: np.ndarray) -> np.ndarray:
        w, h, lanes = self.w, HIDDEN, codes.shape[1]
        f, b = (gru.Steps(w["uf"], lanes), gru.Steps(w["ub"], lanes))
        states = np.empty((WIDTH, 2 * h, lanes), np.float32)
        for t in range(WIDTH):
            np.copyto(f.gates, self.table[codes[t], : 3 * h].T)
            states[t, :h] = f.step()
        for t in range(WIDTH - 1, -1, -1):
            np.copyto(b.gates, self.table[codes[t], 3 * h :].T)
            states[t, h:] = b.step()
        # Attention: one pass over positions with running sums; energies are bounded, so exp() needs no shift.
        total, pooled = np.zeros(lanes, np.float32), np.zeros((2 * h, lanes), np.float32)
        at = np.ascontiguousarray(w["at"].T)
        for t in range(WIDTH):
            e = np.exp(w["av"] @ gru.soft(at @ states[t])) * (codes[t] != 0)
            total += e
            pooled += states[t] * e
        return w["o"] @ (pooled / np.maximum(total, 1e-9)) + w["c"][0]

    def scores(self, texts: list[str]) -> np.ndarray:
        """0 to 1 for each text: its worst window's, 0 for texts without a word."""
        split = [words_of(t) for t in texts]
        logits, doc = self.windows(split)
        worst = np.full(len(texts), -np.inf)
        np.maximum.at(worst, doc, logits.astype(float))
        a, b = self.scale
        return np.where(np.isfinite(worst), 1 / (1 + np.exp(-np.clip(a * np.where(np.isfinite(worst), worst, 0) + b, -30, 30))), 0.0)


def _gradients(net: Net, words: list[list[str]], y: np.ndarray, weight: np.ndarray) -> dict:
    """Gradients of the mean logistic loss over windows."""
    w, h, lanes = net.w, HIDDEN, len(words)
    distinct = sorted(set().union(*words))
    row = {x: i + 1 for i, x in enumerate(distinct)}
    codes = np.zeros((WIDTH, lanes), np.int64)
    for lane, ws in enumerate(words):
        codes[: len(ws), lane] = [row[x] for x in ws]
    hashes, starts, n = _trigrams(distinct)
    vocab = np.array([net.vocab.get(x, 0) for x in distinct])
    x = np.concatenate([np.zeros((1, EMBED), np.float32), np.add.reduceat(w["chars"][hashes], starts, axis=0) / n[:, None].astype(np.float32) + w["words"][vocab]])
    real = codes != 0
    pad = np.zeros(3 * h, np.float32)
    pad[:h] = gru.KEEP
    xs = x[codes]
    gf = np.where(real[:, :, None], xs @ w["wf"] + w["bf"], pad)
    gb = np.where(real[:, :, None], xs @ w["wb"] + w["bb"], pad)[::-1]
    sf, kf = gru.forward(gf, w["uf"])
    sb, kb = gru.forward(gb, w["ub"])
    s = np.concatenate([sf[1:], sb[1:][::-1]], 2)
    a = gru.soft(s @ w["at"])
    e = np.exp(a @ w["av"]) * real
    alpha = e / np.maximum(e.sum(0), 1e-9)
    pooled = (alpha[:, :, None] * s).sum(0)
    p = 1 / (1 + np.exp(-(pooled @ w["o"] + w["c"][0])))
    d = ((p - y) * weight / weight.sum()).astype(np.float32)
    dpooled = d[:, None] * w["o"]
    dalpha = (s * dpooled).sum(2)
    de = alpha * (dalpha - (alpha * dalpha).sum(0))
    da = de[:, :, None] * w["av"] * (1 - np.abs(a)) ** 2
    ds = alpha[:, :, None] * dpooled + da @ w["at"].T
    dgf, duf = gru.backward(np.ascontiguousarray(ds[:, :, :h]), sf, kf, w["uf"])
    dgb, dub = gru.backward(np.ascontiguousarray(ds[:, :, h:][::-1]), sb, kb, w["ub"])
    dgf, dgb = dgf * real[:, :, None], dgb[::-1] * real[:, :, None]
    dx = np.zeros_like(x)
    np.add.at(dx, codes, dgf @ w["wf"].T + dgb @ w["wb"].T)
    dwords, dchars = np.zeros_like(w["words"]), np.zeros_like(w["chars"])
    np.add.at(dwords, vocab, dx[1:])
    dwords[0] = 0
    np.add.at(dchars, hashes, np.repeat(dx[1:] / n[:, None], n, axis=0))
    flat = lambda v: v.reshape(-1, v.shape[2])
    return {
        "words": dwords, "chars": dchars, "wf": flat(xs).T @ flat(dgf), "wb": flat(xs).T @ flat(dgb), "bf": flat(dgf).sum(0), "bb": flat(dgb).sum(0),
        "uf": duf, "ub": dub, "at": flat(s).T @ flat(da), "av": (a * de[:, :, None]).sum((0, 1)), "o": pooled.T @ d, "c": np.array([d.sum()], np.float32),
    }


def train(texts: list[str], labels: list[int], seed: int = 11) -> Net:
    """A network from labelled texts; without both labels it scores every text 0."""
    rng = np.random.default_rng(seed)
    docs = [(words_of(t), int(y)) for t, y in zip(texts, labels, strict=True)]
    docs = [(ws, y) for ws, y in docs if ws]
    seen = Counter(x for ws, _ in docs for x in set(ws))
    common = [x for x, _ in sorted((x for x in seen.items() if x[1] >= max(MIN_DOCS, MIN_SHARE * len(docs))), key=lambda x: (-x[1], x[0]))[:MAX_WORDS]]
    vocab = {x: i + 1 for i, x in enumerate(common)}
    f4 = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
    h = HIDDEN
    w = {
        "words": f4(len(vocab) + 1, EMBED) * 0.3, "chars": f4(TRIGRAMS, EMBED), "wf": f4(EMBED, 3 * h), "wb": f4(EMBED, 3 * h), "bf": f4(3 * h), "bb": f4(3 * h),
        "uf": gru.init(rng, h), "ub": gru.init(rng, h), "at": f4(2 * h, 8), "av": f4(8), "o": f4(2 * h), "c": np.zeros(1, np.float32),
    }
    w["words"][0] = 0
    n_bad, n_good = sum(y for _, y in docs), sum(1 - y for _, y in docs)
    if not n_bad or not n_good:
        return Net(w, vocab, (0.0, -30.0))
    net, adam = Net(w, vocab), gru.Adam(w, RATE)
    calibrate = (rng.random(len(docs)) < 0.2) if min(n_bad, n_good) >= CALIBRATE_FROM else None
    fit = docs if calibrate is None else [x for x, c in zip(docs, calibrate, strict=True) if not c]
    held = docs if calibrate is None else [x for x, c in zip(docs, calibrate, strict=True) if c]
    for epoch in range(DRAWN_EPOCHS + THREE_EPOCHS + WORST_EPOCHS):
        picks = _picked(net, fit, epoch, rng)
        share = float(np.mean([y for _, y in picks]))
        order = rng.permutation(len(picks))
        for k in range(0, len(order), LANES_STEP):
            part = [picks[j] for j in order[k : k + LANES_STEP]]
            y = np.array([b for _, b in part], np.float32)
            adam.step(_gradients(net, [a for a, _ in part], y, np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)))
    net = Net(w, vocab)
    logits, doc = net.windows([ws for ws, _ in held])
    worst = np.full(len(held), -np.inf)
    np.maximum.at(worst, doc, logits.astype(float))
    net.scale = _calibrated(worst, np.array([y for _, y in held], float))
    return net


def _picked(net: Net, docs: list[tuple[list[str], int]], epoch: int, rng: np.random.Generator) -> list[tuple[list[str], int]]:
    """Windows to train on, each with its document's label."""
    logits, at = None, 0
    if epoch >= DRAWN_EPOCHS:
        net.rows.clear()
        net.table = net.table[:0]
        logits, _ = net.windows([ws for ws, _ in docs])
    picks = []
    for ws, y in docs:
        starts = window_starts(len(ws))
        if logits is None:
            chosen = rng.choice(len(starts), min(DRAWN, len(starts)), replace=False)
        else:
            own = logits[at : at + len(starts)]
            worst = np.argsort(-own, kind="stable")
            chosen = worst[: 3 if epoch < DRAWN_EPOCHS + THREE_EPOCHS else 1] if y else [worst[0], rng.integers(len(own))]
        at += len(starts)
        picks += [(ws[starts[k] : starts[k] + WIDTH], y) for k in dict.fromkeys(int(c) for c in chosen)]
    return picks


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from worst-window logits to labels."""
    if not 0 < y.sum() < len(y):
        return 1.0, 0.0
    m, sd = x.mean(), x.std() + 1e-9
    z, a, b = (x - m) / sd, 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, v = p - target, p * (1 - p) + 1e-6
        grad = np.array([(g * z).sum(), g.sum()])
        hess = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - move[0], b - move[1]
    return float(a / sd), float(b - a * m / sd)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Net:
    """Trains on a bounded sample of labelled rows outside the held-out fold.

    Up to ``SAMPLE_ROWS`` ids of each label, those of least hash, with their whole texts.
    Null labels, ids and texts teach nothing; an id that has several labels counts as
    toxic if any is; of several texts of an id, the one of least hash is taken.
    """
    marked = labels.select(F.col(doc_id).alias("i"), F.col(toxic).alias("y")).where("i is not null and y is not null").where(fold(F.col("i"), FOLDS) != HELD_OUT)
    marked = marked.groupBy("i").agg(F.max((F.col("y") >= 0.5).cast("int")).alias("k"))
    chosen = bounded(marked, "k", "i", SAMPLE_ROWS, 2 * SAMPLE_ROWS)
    found = sampled(docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")), chosen)
    return train([r["t"] for r in found], [r["k"] for r in found])


def score(docs: DataFrame, net: Net, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, over whole texts.

    Null texts and texts without a word score 0. ``held_out`` is false for a null id.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = net.scores([t or "" for t in batch.column(2).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(fold(F.col(doc_id), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return map_batches(rows, run, f"doc_id {kind(docs, doc_id)}, held_out boolean, score double, predicted int")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels outside the held-out fold."""
    docs = documents(spark, sf_dir)
    return score(spread(docs), learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
