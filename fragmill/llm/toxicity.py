"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of w[t] + sum over pairs of <v[t], v[u]>), t and u distinct terms of the text.  The pair
term costs as much as the linear one: half of |sum of v|^2 - sum of |v|^2.  Terms are words and, for longer words, their
first letters, hashed into a fixed number of slots, so the model has one size whatever the corpus.  It is fitted on a
bounded sample of labelled rows, in one task that holds no more than that sample, and broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, in_blocks, in_use, mapped, per_text, row_of, text_or_empty, written

#: Bound of the labelled sample, hashed slots, factors, rows a term needs in the sample, letters of a word's stems.
TRAIN_ROWS, SLOTS, FACTORS, LEAST_ROWS, STEMS = 16_000, 1 << 20, 4, 4, (4, 5, 6)
#: Rows of a step, steps and epochs at least, rates of weights and factors, pull of both to zero, spread of first factors.
BATCH, STEPS, EPOCHS, RATES, PULLS, SPREAD = 128, 1000, 6, (0.1, 0.05), (3e-3, 1.5e-3), 0.03
REMEMBERED = 120_000
_WORD = re.compile(r"[^\W_]+")


class Terms(dict):
    """Word -> its slots, remembered within a bound."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        slots = [zlib.crc32(word.encode("utf-8", "replace")) % SLOTS]
        slots += [zlib.crc32(b"^" + word[:n].encode("utf-8", "replace")) % SLOTS for n in STEMS if len(word) > n]
        self[word] = out = tuple(slots)
        return out

    def of(self, text: str) -> np.ndarray:
        """The distinct slots of a text, ascending."""
        in_use(self)
        slots: set[int] = set()
        slots.update(*map(self.__getitem__, set(_WORD.findall(text.lower()))))
        out = np.fromiter(slots, dtype=np.int32, count=len(slots))
        out.sort()
        return out


_TERMS = Terms()


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """w (float32 by slot), v (slots x FACTORS), bias.

    Every slot of enough rows takes part, whatever its own share of toxic rows, so terms that tell only as a pair are
    learnt.  Adaptive steps; after each, a weight is pulled to zero by a constant, a slot's factors by a constant in
    length, so slots that do not help end at zero.
    """
    n, factors = len(rows), FACTORS
    w_all, v_all = np.zeros(SLOTS, np.float32), np.zeros((SLOTS, factors), np.float32)
    labels = np.asarray(labels, dtype=np.float32)
    if not n or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (n + 1)
        return {"w": w_all, "v": v_all, "bias": np.float32(np.log(share / (1 - share)))}
    seen = np.zeros(SLOTS, np.int32)
    for r in rows:
        seen[r] += 1  # the slots of a row are distinct
    slots = np.flatnonzero(seen >= LEAST_ROWS)
    place = np.full(SLOTS, -1, np.int32)
    place[slots] = np.arange(m := len(slots))
    size = np.array([int((seen[r] >= LEAST_ROWS).sum()) for r in rows])
    flat = np.empty(int(size.sum()), np.int32)
    for r, end in zip(rows, np.cumsum(size)):
        x = place[r]
        flat[end - (x >= 0).sum() : end] = x[x >= 0]
    start = np.cumsum(size) - size
    rng = np.random.default_rng(seed)
    w, v = np.zeros(m, np.float32), rng.normal(0, SPREAD, (m, factors)).astype(np.float32)
    gw, gv, gb = np.full(m, 1e-2, np.float32), np.full((m, factors), 1e-2, np.float32), 1e-2
    bias = np.float32(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // n))):
        order = rng.permutation(n)
        for s in range(0, n, BATCH):
            pick = order[s : s + BATCH]
            k = size[pick]
            of = np.repeat(np.arange(len(pick)), k)
            x = flat[np.repeat(start[pick] - np.cumsum(k) + k, k) + np.arange(k.sum())]
            fv = v[x]
            sums = np.stack([np.bincount(of, fv[:, f], len(pick)) for f in range(factors)], 1).astype(np.float32)
            z = bias + np.bincount(of, w[x], len(pick)) + 0.5 * ((sums**2).sum(1) - np.bincount(of, (fv**2).sum(1), len(pick)))
            err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)).astype(np.float32)
            e = err[of]
            dw = np.bincount(x, e, m).astype(np.float32)
            dv = np.stack([np.bincount(x, e * (sums[of, f] - fv[:, f]), m) for f in range(factors)], 1).astype(np.float32)
            dv = np.clip(dv, -1, 1)
            gw += dw**2
            gv += dv**2
            gb += float(err.sum()) ** 2
            step = RATES[0] / np.sqrt(gw)
            w -= step * dw
            w = np.sign(w) * np.maximum(np.abs(w) - step * PULLS[0], 0)
            v -= RATES[1] * dv / np.sqrt(gv)
            v *= np.maximum(0, 1 - RATES[1] * PULLS[1] / np.sqrt(gv.mean(1)) / np.maximum(np.sqrt((v * v).sum(1)), 1e-12))[:, None]
            bias -= np.float32(RATES[0] * err.sum() / np.sqrt(gb))
    w_all[slots], v_all[slots] = w, v
    return {"w": w_all, "v": v_all, "bias": bias}


def score(model: dict[str, np.ndarray], terms: list[np.ndarray]) -> np.ndarray:
    out = np.empty(len(terms))
    w, v, bias = model["w"], model["v"], float(model["bias"])
    for i, t in enumerate(terms):
        x = v[t]
        s = x.sum(0)
        out[i] = bias + w[t].sum() + 0.5 * float((s * s).sum() - (x * x).sum())
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict[str, np.ndarray]:
    """A model from at most `train_rows` labelled rows outside the held-out fold, chosen by a hash of their ids."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
    known = written(known.select(F.col("doc_id").alias("_id"), "_toxic"), "toxic-labels")
    share = min(1.0, 0.97 * train_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1_000_000)) < int(share * 1_000_000)).limit(train_rows)
    texts = docs.select(docs["doc_id"].alias("_id"), text_or_empty(docs).alias("_text"))
    rows = texts.join(F.broadcast(chosen), "_id").select("_toxic", "_text")  # at most train_rows ids

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for s in in_blocks(texts):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.start, s.stop - s.start), pa.array([_TERMS.of(t).tobytes() for t in texts[s]], pa.binary())], names=["y", "t"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, t = [], []
        for b in batches:
            y += b.column(0).to_pylist()
            t += [np.frombuffer(x, dtype=np.int32) for x in b.column(1).to_pylist()]
        order = sorted(range(len(y)), key=lambda i: (zlib.crc32(t[i].tobytes()), y[i]))  # the same model however rows come in
        m = fit([t[i] for i in order], np.array([y[i] for i in order]))
        used = np.flatnonzero((m["w"] != 0) | (m["v"] != 0).any(1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (used, m["w"][used], m["v"][used], np.float32(m["bias"]).reshape(1))], names=["u", "w", "v", "b"])

    sample = written(mapped(rows, terms, "y int, t binary"), "toxic-sample")  # all tasks read; one then takes what is bounded
    got = written(mapped(sample.coalesce(1), learn, "u binary, w binary, v binary, b binary"), "toxic-model").first()
    used = np.frombuffer(got["u"], np.int32)
    w, v = np.zeros(SLOTS, np.float32), np.zeros((SLOTS, FACTORS), np.float32)
    w[used], v[used] = np.frombuffer(got["w"], np.float32), np.frombuffer(got["v"], np.float32).reshape(-1, FACTORS)
    return {"w": w, "v": v, "bias": np.frombuffer(got["b"], np.float32)[0]}


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, score (0 to 1), predicted (1 if score >= 0.3) of every whole text.

    Null text counts as empty; empty texts get the bias alone.  Without usable labels, or with one class only, the score
    is the smoothed share of toxic rows.  Repeated rows get a row each; ids that repeat in labels are toxic if any row
    is.  Texts of any length are read whole.  An empty table gives an empty one; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_rows))

    def run(texts: list[str]) -> dict[str, list]:
        p = score(sent.value, [_TERMS.of(t) for t in texts])
        return {"score": p, "predicted": (p >= 0.3).astype(np.int32)}

    return per_text(docs, run, "score double, predicted int", keep)


def drop_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs whose score is below 0.3, all columns as they were, whatever their names.

    Null and empty texts have the bias alone for a score; repeated rows stay or go together; texts of any length are
    read whole; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_rows))

    def run(texts: list[str]) -> dict[str, list]:
        return {"rejected": score(sent.value, [_TERMS.of(t) for t in texts]) >= 0.3}

    rows = docs.select(row_of(docs).alias("payload"), docs["text"].alias("text"))
    return per_text(rows, run, "rejected boolean", ("payload",)).where("not rejected").select("payload.*")
