"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starprism.llm.common import batches, id_and_text, remainder, texts_of
from starprism.llm.nn import Adam, both_back, both_ways, glorot, sigmoid
from starprism.llm.sampling import stratified

#: Each run of the network labels STEPS bytes and reads CONTEXT more on either side, so that every byte of a text of any
#: length is labelled with its states carried over words, and long texts are labelled many runs at once.
STEPS, CONTEXT = 256, 32
_PAD = 256
UNKNOWN = "und"


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, one after another, and how many each has."""
    data = texts.cast(pa.binary())
    return np.frombuffer(b"".join(data.to_pylist()), np.uint8), pc.binary_length(data).to_numpy().astype(np.int64)


def runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs over texts of these sizes: text, first byte read, bytes read, first byte labelled (from the first read), and
    bytes labelled. An empty text has no run; every byte of the others is labelled once."""
    count = -(-sizes // STEPS)
    of = np.repeat(np.arange(len(sizes)), count)
    own = STEPS * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    size = sizes[of]
    low, high = np.maximum(0, own - CONTEXT), np.minimum(size, own + STEPS + CONTEXT)
    base = (np.cumsum(sizes) - sizes)[of]
    return of, base + low, high - low, own - low, np.minimum(STEPS, size - own)


class ByteLabeller:
    """Labels every byte with class probabilities from the states of both directions."""

    def __init__(self, classes: list[str], hidden: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {
            "embed": np.vstack([glorot(rng, 256, 6 * hidden) * 3, np.zeros((1, 6 * hidden), np.float32)]),
            "uf": glorot(rng, 3 * hidden, hidden), "ub": glorot(rng, 3 * hidden, hidden),
            "out": glorot(rng, len(classes), 2 * hidden), "bias": np.zeros((len(classes), 1), np.float32),
        }

    def _labels(self, states: np.ndarray) -> np.ndarray:
        logits = np.matmul(self.p["out"], states) + self.p["bias"]
        np.exp(logits - logits.max(axis=-2, keepdims=True), out=logits)
        logits /= logits.sum(axis=-2, keepdims=True)
        return logits

    def states(self, codes: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """(T, 2h, n) states of codes (T, n); the same as ``both_ways``, with each step's inputs looked up as it is taken."""
        h = len(self.p["uf"]) // 3
        out = np.empty((len(codes), 2 * h, codes.shape[1]), np.float32)
        for half, u, order in ((0, self.p["uf"], range(len(codes))), (1, self.p["ub"], range(len(codes) - 1, -1, -1))):
            table = np.ascontiguousarray(self.p["embed"][:, 3 * h * half : 3 * h * (half + 1)].T)
            state = np.zeros((h, codes.shape[1]), np.float32)
            for t in order:
                x, a = np.take(table, codes[t], axis=1), u @ state
                gates = sigmoid(x[: 2 * h] + a[: 2 * h])
                c = np.tanh(x[2 * h :] + gates[h:] * a[2 * h :])
                step = gates[:h] if mask is None else gates[:h] * mask[t]
                state = state + step * (c - state)
                out[t, h * half : h * (half + 1)] = state
        return out

    def train(self, data: np.ndarray, labels: np.ndarray, epochs: int = 5, batch: int = 128, seed: int = 6) -> ByteLabeller:
        """Back-propagation through time over rows of codes, padded with 256; each byte's target is its document's language."""
        rng, adam = np.random.default_rng(seed), Adam(self.p, 0.01)
        for _ in range(epochs):
            order = rng.permutation(len(data))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                codes = data[rows].T
                mask = (codes < _PAD).astype(np.float32)[:, None, :]
                keep: tuple = ([], [])
                states = both_ways(np.ascontiguousarray(self.p["embed"][codes].transpose(0, 2, 1)), mask, self.p["uf"], self.p["ub"], keep)
                d = self._labels(states)
                d[:, labels[rows], np.arange(len(rows))] -= 1
                d *= mask / mask.sum()
                grads = {"out": np.einsum("tkn,thn->kh", d, states, optimize=True), "bias": d.sum(axis=(0, 2))[:, None]}
                dx, grads["uf"], grads["ub"] = both_back(np.matmul(self.p["out"].T, d), mask, self.p["uf"], self.p["ub"], keep)
                grads["embed"] = np.zeros_like(self.p["embed"])
                flat, at = dx.transpose(0, 2, 1).reshape(-1, dx.shape[1]), codes.reshape(-1)
                by = np.argsort(at, kind="stable")
                heads = np.flatnonzero(np.diff(at[by], prepend=-1))
                grads["embed"][at[by][heads]] = np.add.reduceat(flat[by], heads, axis=0)
                grads["embed"][_PAD] = 0
                adam.step(grads)
        return self

    def pooled(self, texts: pa.Array, chunk: int = 512) -> np.ndarray:
        """(texts, classes): the sum of each text's byte labels."""
        flat, sizes = flat_bytes(texts)
        of, first, read, lead, own = runs(sizes)
        out = np.zeros((len(sizes), len(self.classes)), np.float64)
        order = np.argsort(read, kind="stable")
        for a in range(0, len(order), chunk):
            r = order[a : a + chunk]
            steps = np.arange(int(read[r].max()))[:, None]
            there = steps < read[r]
            codes = np.where(there, flat[np.minimum(first[r] + steps, len(flat) - 1)], _PAD)
            states = self.states(codes, None if there.all() else there.astype(np.float32)[:, None, :])
            labelled = (steps >= lead[r]) & (steps < lead[r] + own[r])
            sums = np.zeros((len(self.classes), len(r)), np.float32)
            for t in range(0, len(codes), 32):
                sums += (self._labels(states[t : t + 32]) * labelled[t : t + 32, None, :]).sum(axis=0)
            np.add.at(out, of[r], sums.T)
        return out


def fit(docs: DataFrame, each: int = 500, pieces: int = 4, longest: int = 96) -> ByteLabeller | None:
    """Trains on a bounded sample: about ``each`` documents of every language, of each of them ``pieces`` stretches of
    ``longest`` bytes at random places, of rows with a non-null lang and crc32(doc_id) mod 4 other than 2. None if there
    is no such row with a letter."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    sample = sorted((r["doc_id"], r["lang"], r["text"]) for r in stratified(known, "lang", each).collect())
    rng, rows, labels = np.random.default_rng(4), [], []
    classes = sorted({lang for _, lang, _ in sample})
    for _, lang, text in sample:
        if not any(c.isalpha() for c in text):
            continue
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        for at in sorted({int(x) for x in rng.integers(0, max(1, len(data) - longest + 1), pieces)}):
            row = np.full(longest, _PAD, np.int64)
            row[: len(data[at : at + longest])] = data[at : at + longest]
            rows.append(row)
            labels.append(classes.index(lang))
    return ByteLabeller(classes).train(np.stack(rows), np.array(labels)) if rows else None


def identify(docs: DataFrame, model: ByteLabeller | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of whole texts: the mean of the label probabilities of all bytes.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing could be learned.
    A null doc_id isn't held out. Ties go to the language first in order. Texts of any length are labelled whole.
    Repeated rows are rows; other columns, whatever their names, play no part. An empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in found:
            texts = texts_of(batch)
            known = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False) & (net is not None)
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if known.any():
                sums = net.pooled(texts.filter(pa.array(known)))
                best = sums.argmax(axis=1)
                lang[known] = np.array(net.classes, object)[best]
                score[known] = np.clip(sums[np.arange(len(best)), best] / sums.sum(axis=1), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    batches(docs.sparkSession)
    out = id_and_text(docs).mapInArrow(predicted, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6(docs: DataFrame) -> DataFrame:
    """``identify`` of all documents by a network that ``fit`` trains on those that aren't held out."""
    return identify(docs, fit(docs))
