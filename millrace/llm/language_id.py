"""Language identification by a bidirectional gated recurrent network over bytes.

Both directions read a stretch of bytes and some of what is before and after it; the two
states at a byte give the probabilities of the languages there; a document's are the mean
over all its bytes. Trained in numpy by backpropagation through time on the languages of
a bounded sample of labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import gru
from millrace.llm.common import bounded, documents, fold, kind, map_batches, sampled
from millrace.session import spread

FOLDS, HELD_OUT = 4, 2
HIDDEN = 12
#: Bytes of a stretch, and of the text on either side that its states read first: so all stretches of all texts run side by side.
STRETCH, MARGIN = 128, 16
LANES = 4096
PAD = 256
#: The bound of the training sample: rows per language, and in all. Their texts are whole.
SAMPLE_ROWS, SAMPLE_TOTAL = 250, 20_000
TRAIN_STEPS, TRAIN_LANES, TRAIN_STRETCH, RATE = 160, 64, 96, 0.02


def train(texts: list[bytes], langs: list[str], seed: int = 7) -> dict:
    """The network's weights and its languages, from labelled texts."""
    rng, names = np.random.default_rng(seed), sorted(set(langs))
    k, h = len(names), HIDDEN
    f4 = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    w = {"xf": f4(257, 3 * h), "xb": f4(257, 3 * h), "uf": gru.init(rng, h), "ub": gru.init(rng, h), "of": f4(h, k), "ob": f4(h, k), "c": np.zeros(k, np.float32)}
    if k > 1:
        adam = gru.Adam(w, RATE)
        by_lang = [[t for t, x in zip(texts, langs, strict=True) if x == name and t] or [b" "] for name in names]
        for _ in range(TRAIN_STEPS):
            y = rng.integers(0, k, TRAIN_LANES)
            codes = np.full((TRAIN_STRETCH, TRAIN_LANES), PAD)
            for lane, lang in enumerate(y):
                t = by_lang[lang][rng.integers(len(by_lang[lang]))]
                at = rng.integers(max(len(t) - TRAIN_STRETCH, 0) + 1)
                part = np.frombuffer(t[at : at + TRAIN_STRETCH], np.uint8)
                codes[: len(part), lane] = part
            adam.step(_gradients(w, codes, y))
    return w | {"names": names}


def _gradients(w: dict, codes: np.ndarray, y: np.ndarray) -> dict:
    steps, lanes = codes.shape
    mask = (codes != PAD).astype(np.float32)[:, :, None]
    gf, gb, h = w["xf"][codes], w["xb"][codes[::-1]], w["uf"].shape[0]
    gb[codes[::-1] == PAD, :h] = gru.KEEP  # the backward state stays zero until the last byte
    sf, kf = gru.forward(gf, w["uf"])
    sb, kb = gru.forward(gb, w["ub"])
    f, b = sf[1:], sb[1:][::-1]
    logits = f @ w["of"] + b @ w["ob"] + w["c"]
    p = np.exp(logits - logits.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    p[:, np.arange(lanes), y] -= 1
    d = p * mask / max(float(mask.sum()), 1)
    flat = d.reshape(-1, d.shape[2])
    dgf, duf = gru.backward(d @ w["of"].T, sf, kf, w["uf"])
    dgb, dub = gru.backward((d @ w["ob"].T)[::-1], sb, kb, w["ub"])
    hot = (codes.reshape(-1)[None, :] == np.arange(257)[:, None]).astype(np.float32)
    hot_b = (codes[::-1].reshape(-1)[None, :] == np.arange(257)[:, None]).astype(np.float32)
    return {
        "xf": hot @ dgf.reshape(steps * lanes, -1), "xb": hot_b @ dgb.reshape(steps * lanes, -1), "uf": duf, "ub": dub,
        "of": f.reshape(-1, h).T @ flat, "ob": b.reshape(-1, h).T @ flat, "c": flat.sum(0),
    }


class Scorer:
    """Document probabilities of a trained network."""

    def __init__(self, w: dict):
        h = w["uf"].shape[0]
        self.names = w["names"]
        self.lanes = max(64, min(LANES, LANES * 8 // max(len(self.names), 1)))  # bounds ``ahead``
        self.tables = []
        for x in (w["xf"], w["xb"]):
            x = x.copy()
            x[PAD] = 0
            x[PAD, :h] = gru.KEEP  # a state before the first byte stays zero
            self.tables.append(np.ascontiguousarray(x.T))
        self.steps = [gru.Steps(w["uf"], self.lanes), gru.Steps(w["ub"], self.lanes)]
        self.of, self.ob, self.c = np.ascontiguousarray(w["of"].T), np.ascontiguousarray(w["ob"].T), w["c"][:, None]
        self.ahead = np.empty((STRETCH, len(self.names), self.lanes), np.float32)

    def _lanes(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums, over each lane's own bytes (from ``MARGIN`` on), of the languages' probabilities at the byte."""
        f, b = self.steps
        f.state[:], b.state[:] = 0, 0
        last, full = int(lengths.max()), int(lengths.min())
        for t in range(MARGIN + last):
            np.take(self.tables[0], codes[t], axis=1, out=f.gates, mode="clip")
            state = f.step()
            if t >= MARGIN:
                np.dot(self.of, state, out=self.ahead[t - MARGIN])
        sums = np.zeros((len(self.names), self.lanes), np.float32)
        for t in range(last + MARGIN - 1, -1, -1):
            np.take(self.tables[1], codes[t + MARGIN], axis=1, out=b.gates, mode="clip")
            state = b.step()
            if t >= last:
                continue
            p = self.ob @ state
            p += self.ahead[t]
            p += self.c
            p -= p.max(0)
            np.exp(p, out=p)
            p /= p.sum(0)
            if t >= full:
                p *= lengths > t
            sums += p
        return sums

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all bytes, a row per text (of one byte at least)."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n = -(-sizes // STRETCH)
        doc = np.repeat(np.arange(len(texts)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at, size = starts[doc] + nth * STRETCH, np.minimum(sizes[doc] - nth * STRETCH, STRETCH)
        order = np.argsort(-size, kind="stable")
        out = np.zeros((len(texts), len(self.names)))
        step = np.arange(-MARGIN, STRETCH + MARGIN)[:, None]
        for i in range(0, len(order), self.lanes):
            lanes = order[i : i + self.lanes]
            lengths, first, low, high = (np.zeros(self.lanes, np.int64) for _ in range(4))
            lengths[: len(lanes)], first[: len(lanes)] = size[lanes], at[lanes]
            low[: len(lanes)], high[: len(lanes)] = starts[doc[lanes]], starts[doc[lanes]] + sizes[doc[lanes]]
            places = first + step
            codes = data[np.clip(places, 0, len(data) - 1)].astype(np.intp)
            codes[(places < low) | (places >= high)] = PAD
            sums = self._lanes(codes, lengths)
            np.add.at(out, doc[lanes], sums[:, : len(lanes)].T)
        return out / np.maximum(sizes, 1)[:, None]


def identify(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` as ``doc_id, held_out, lang_pred, score`` for every row.

    Texts that are null or have no letter are ``und`` with score 0, as are all if no
    language was learned; else the score is the mean probability of the language.
    ``held_out`` is false for a null id.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        known = [i for i, t in enumerate(texts) if model["names"] and any(map(str.isalpha, t))]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if known:
            p = _scorer(model).documents([texts[i].encode() for i in known])
            for i, row in zip(known, p, strict=True):
                best = int(row.argmax())
                names[i], scores[i] = model["names"][best], float(min(max(row[best], 0.0), 1.0))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(fold(F.col(doc_id), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return map_batches(rows, run, f"doc_id {kind(docs, doc_id)}, held_out boolean, lang_pred string, score double")


_LAST: list = [None, None]


def _scorer(model: dict) -> Scorer:
    """The scorer of the model that this worker has at hand; its buffers are reused."""
    if _LAST[0] is not model:
        _LAST[:] = [model, Scorer(model)]
    return _LAST[1]


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """Trains on a bounded sample of rows outside the held-out fold that have a language.

    Up to ``SAMPLE_ROWS`` ids of each language, fewer where that makes more than
    ``SAMPLE_TOTAL`` rows, with their whole texts; every language has its share, however
    rare. Null languages, ids and texts teach nothing.
    """
    rows = docs.select(F.col(doc_id).alias("i"), F.col(lang).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null").where(fold(F.col("i"), FOLDS) != HELD_OUT)
    found = sampled(rows, bounded(rows, "k", "i", SAMPLE_ROWS, SAMPLE_TOTAL))
    return train([r["t"].encode() for r in found], [r["k"] for r in found])


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those outside the held-out fold."""
    docs = documents(spark, sf_dir)
    return identify(spread(docs), learn(docs))
