"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from starprism.llm.common import Rows, WordCache, batches, free_name, id_and_text, list_parts, parts_of, releasing, remainder, spread, texts_of
from starprism.llm.nn import Adam, both_back, both_ways, glorot, sigmoid
from starprism.llm.sampling import stratified

WINDOW, STRIDE = 24, 12  # words; windows overlap by half
WORD_BUCKETS, GRAM_BUCKETS = 1 << 18, 1 << 17
WORD_DIM, GRAM_DIM, HIDDEN = 8, 8, 10
LEAST_DOCS = 5  # vectors of words and runs in fewer training documents stay 0, as those of unknown ones
_EDGES = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])) + "«»“”„’‘–—…¿¡"


def word_buckets(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in words), np.int64, len(words))


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's runs of 3, 4 and 5 bytes, with marks at both ends, and how many each word has."""
    data = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    first = np.flatnonzero(data == 2)
    ends = np.append(first[1:], len(data))
    left = np.repeat(ends, ends - first) - np.arange(len(data))  # bytes from here to the word's end
    of = np.repeat(np.arange(len(first)), ends - first)
    found, owner = [], []
    with np.errstate(over="ignore"):
        for n in (3, 4, 5):
            h = np.full(max(0, len(data) - n + 1), n, np.uint32)
            for j in range(n):
                h = h * np.uint32(0x01000193) + data[j : len(data) - n + 1 + j] * np.uint32(0x9E3779B1)
            whole = left[: len(h)] >= n
            found.append((h[whole] ^ (h[whole] >> np.uint32(15))) % GRAM_BUCKETS)
            owner.append(of[: len(h)][whole])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.bincount(owner, minlength=len(words))


def _clean(words: list[str]) -> list[str]:
    return [w.strip(_EDGES).replace("\x02", " ").replace("\x03", " ") for w in words]


def windows(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and document of each overlapping window; every word is in one at least."""
    size = np.diff(ends)
    count = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1)
    of = np.repeat(np.arange(len(size)), count)
    start = STRIDE * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    return ends[of] + start, np.minimum(WINDOW, size[of] - start), of


class WindowNet:
    """Per word the word's vector and the mean of its character runs' vectors; over a window's words a bidirectional
    network, attention pooling and one logit. A document's logit is its windows' largest. Everything is learned from
    random beginnings by back-propagation; no statistic of the labels is an input."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        self.word = np.zeros((WORD_BUCKETS, WORD_DIM), np.float32)  # words and runs never met, or too rare, stay at 0
        self.gram = np.zeros((GRAM_BUCKETS, GRAM_DIM), np.float32)
        self.p = {
            "in": glorot(rng, d, 6 * h), "b": np.zeros((1, 6 * h), np.float32),
            "uf": glorot(rng, 3 * h, h), "ub": glorot(rng, 3 * h, h),
            "att": glorot(rng, 1, 2 * h), "out": glorot(rng, 1, 2 * h), "bias": np.full((1, 1), -1, np.float32),
        }

    def inputs(self, words: list[str]) -> np.ndarray:
        """Word and character inputs, (words, dimensions); words are already clean."""
        return np.concatenate([self._inputs(words[a : a + 10_000]) for a in range(0, len(words), 10_000)]) if words else np.zeros((0, len(self.p["in"])), np.float32)

    def _inputs(self, words: list[str]) -> np.ndarray:
        grams, count = gram_buckets(words)
        at = np.cumsum(count) - count
        mean = np.zeros((len(words), GRAM_DIM), np.float32)
        some = count > 0
        if some.any():
            mean[some] = np.add.reduceat(self.gram[grams], at[some], axis=0) / count[some, None]
        return np.hstack([self.word[word_buckets(words)], mean])

    def logits(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """One logit a window. x: (T, 6h, n); mask: (T, 1, n)."""
        rec = ([], []) if keep is not None else None
        states = both_ways(x, mask, self.p["uf"], self.p["ub"], rec)
        a = np.matmul(self.p["att"], states)
        a = np.exp(np.clip(a, -30, 30)) * mask
        a /= a.sum(axis=0, keepdims=True) + 1e-9
        pooled = (states * a).sum(axis=0)
        if keep is not None:
            keep |= {"rec": rec, "states": states, "a": a, "pooled": pooled}
        return (self.p["out"] @ pooled + self.p["bias"])[0]

    def grads(self, x: np.ndarray, mask: np.ndarray, d_logit: np.ndarray, keep: dict) -> tuple[dict, np.ndarray]:
        states, a, pooled = keep["states"], keep["a"], keep["pooled"]
        g = {"out": d_logit[None] @ pooled.T, "bias": d_logit.sum().reshape(1, 1)}
        dp = self.p["out"].T @ d_logit[None]
        da = (states * dp[None]).sum(axis=1, keepdims=True)
        ds = a * (da - (a * da).sum(axis=0, keepdims=True))
        g["att"] = np.einsum("tun,thn->uh", ds, states, optimize=True)
        dx, g["uf"], g["ub"] = both_back(a * dp[None] + self.p["att"].T[None] * ds, mask, self.p["uf"], self.p["ub"], keep["rec"])
        return g, dx

    def projected(self, words: list[str]) -> np.ndarray:
        """The gates' input parts of each word, for both directions."""
        return self.inputs(words) @ self.p["in"] + self.p["b"]

    def scores(self, rows: np.ndarray, start: np.ndarray, size: np.ndarray, numbers: np.ndarray, chunk: int = 1024) -> np.ndarray:
        """Logits of windows over words given by their numbers in ``rows`` (projected words)."""
        out = np.empty(len(start), np.float32)
        steps = np.arange(WINDOW)
        for a in range(0, len(start), chunk):
            s, n = start[a : a + chunk], size[a : a + chunk]
            live = steps[:, None] < n
            which = numbers[np.minimum(s + steps[:, None], len(numbers) - 1)]
            x = np.ascontiguousarray(rows[which].transpose(0, 2, 1))
            out[a : a + chunk] = self.logits(x, live.astype(np.float32)[:, None, :])
        return out


def _in_documents(parts: Iterable[tuple[np.ndarray, np.ndarray]], n_buckets: int) -> np.ndarray:
    """In how many documents each bucket is. ``parts``: (documents, buckets) of some documents each."""
    out = np.zeros(n_buckets, np.int64)
    for docs_of, buckets in parts:
        out += np.bincount(np.unique(docs_of * n_buckets + buckets) % n_buckets, minlength=n_buckets)
    return out


class RowAdagrad:
    """Steps for the few rows of a large table that a batch meets."""

    def __init__(self, table: np.ndarray, rate: float):
        self.table, self.rate, self.sum = table, rate, np.full(len(table), 1e-8, np.float32)

    def step(self, at: np.ndarray, grads: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        heads = np.flatnonzero(np.diff(at[order], prepend=-1))
        rows, g = at[order][heads], np.add.reduceat(grads[order], heads, axis=0)
        self.sum[rows] += (g * g).mean(axis=1)
        self.table[rows] -= self.rate * g / np.sqrt(self.sum[rows])[:, None]


def _not_copies(texts: list[str], run: int = 4, least: int = 8) -> list[int]:
    """The texts that share at most one of their ``least`` smallest hashes of word runs with texts before them: words of
    one text in many copies would look like evidence."""
    seen: set[int] = set()
    kept = []
    for i, text in enumerate(texts):
        words = text.split()
        own = sorted({zlib.crc32(" ".join(words[j : j + run]).encode("utf-8", "surrogatepass")) for j in range(max(1, len(words) - run + 1))})[:least]
        if len(seen.intersection(own)) < min(2, len(own)):
            kept.append(i)
        seen.update(own)
    return kept


def train(texts: list[str], label: np.ndarray, warm: int = 6, epochs: int = 6, seed: int = 2) -> WindowNet:
    """Learns from whole documents' labels, one of each group of copies. First, windows are drawn at random and take their
    document's label (``warm`` times); then each document is learned by its window with the largest logit, and those
    that are not toxic by one more at random (``epochs`` times). Word and character vectors, the recurrent network and
    the attention are trained together by back-propagation through time, from random beginnings."""
    net, rng = WindowNet(), np.random.default_rng(seed)
    kept = _not_copies(texts)
    texts, label = [texts[i] for i in kept], label[kept]
    flat, ends = list_parts(pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.string()))))
    coded = flat.dictionary_encode()
    words = _clean(coded.dictionary.to_pylist())
    numbers = coded.indices.to_numpy().astype(np.int64)
    wb = word_buckets(words)
    all_grams, gram_count = gram_buckets(words)
    gram_at = np.cumsum(gram_count) - gram_count

    def parts(character: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a in range(0, len(texts), 100):
            b = min(len(texts), a + 100)
            of, own = np.repeat(np.arange(a, b), np.diff(ends[a : b + 1])), numbers[ends[a] : ends[b]]
            if not character:
                yield of, wb[own]
                continue
            pairs = np.unique(of * len(words) + own)  # each word of a document once
            of, own = pairs // len(words), pairs % len(words)
            yield np.repeat(of, gram_count[own]), all_grams[spread(gram_at[own], gram_count[own])]

    word_known, gram_known = _in_documents(parts(False), WORD_BUCKETS) >= LEAST_DOCS, _in_documents(parts(True), GRAM_BUCKETS) >= LEAST_DOCS
    for table, known in ((net.word, word_known), (net.gram, gram_known)):
        table[known] = 0.1 * rng.standard_normal((int(known.sum()), table.shape[1]))
    start, size, of = windows(ends)
    first, n_win = np.searchsorted(of, np.arange(len(texts))), np.bincount(of, minlength=len(texts))
    adam, steps = Adam(net.p, 0.01), np.arange(WINDOW)
    word_steps, gram_steps = RowAdagrad(net.word, 0.1), RowAdagrad(net.gram, 0.05)
    drawn = lambda docs: first[docs] + (rng.random(len(docs)) * n_win[docs]).astype(np.int64)
    toxic, other = np.flatnonzero(label == 1), np.flatnonzero(label != 1)
    for epoch in range(warm + epochs):
        if epoch < warm:
            chosen = np.concatenate([drawn(np.repeat(toxic, 8)), drawn(np.repeat(other, 2))])
        else:
            logit = net.scores(net.projected(words), start, size, numbers)
            best = np.lexsort((logit, of))[np.append(np.flatnonzero(np.diff(of)), len(of) - 1)]
            chosen = np.concatenate([best, drawn(other)])
        chosen = rng.permutation(chosen)
        for a in range(0, len(chosen), 64):
            w = chosen[a : a + 64]
            live = (steps[:, None] < size[w]).astype(np.float32)[:, None, :]
            which = numbers[np.minimum(start[w] + steps[:, None], len(numbers) - 1)]
            used, back = np.unique(which, return_inverse=True)
            own_grams, own_count = all_grams[spread(gram_at[used], gram_count[used])], gram_count[used]
            x_in = np.hstack([net.word[wb[used]], np.zeros((len(used), GRAM_DIM), np.float32)])
            some = own_count > 0
            if some.any():
                x_in[some, WORD_DIM:] = np.add.reduceat(net.gram[own_grams], (np.cumsum(own_count) - own_count)[some], axis=0) / own_count[some, None]
            x = (x_in @ net.p["in"] + net.p["b"])[back.reshape(which.shape)].transpose(0, 2, 1)
            keep: dict = {}
            d = ((sigmoid(net.logits(x, live, keep)) - label[of[w]]) / len(w)).astype(np.float32)
            g, dx = net.grads(x, live, d, keep)
            flat_back = back.reshape(-1)
            order = np.argsort(flat_back, kind="stable")
            heads = np.flatnonzero(np.diff(flat_back[order], prepend=-1))
            d_rows = np.add.reduceat(dx.transpose(0, 2, 1).reshape(-1, dx.shape[1])[order], heads, axis=0)
            g["in"], g["b"] = x_in.T @ d_rows, d_rows.sum(axis=0, keepdims=True)
            d_in = d_rows @ net.p["in"].T
            adam.step(g)
            learn = word_known[wb[used]]
            word_steps.step(wb[used][learn], d_in[learn, :WORD_DIM])
            each = np.repeat(d_in[:, WORD_DIM:] / np.maximum(own_count, 1)[:, None], own_count, axis=0)
            learn = gram_known[own_grams]
            gram_steps.step(own_grams[learn], each[learn])
    return net


def fit(docs: DataFrame, labels: DataFrame, each: int = 1500, longest: int = 20_000) -> WindowNet | None:
    """Trains on a bounded sample: about ``each`` documents of each label, of labelled rows with crc32(doc_id) mod 5
    other than 0 and texts of at most ``longest`` characters. Ids with several labels are toxic if one is. None if no row is labelled."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("toxic").isNotNull() & (remainder(F.col("doc_id"), 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = stratified(known, "toxic", each)
    rows = id_and_text(docs).where(F.col("text").isNotNull() & (F.length("text") <= longest)).join(F.broadcast(chosen), "doc_id").collect()  # the sample's ids are bounded
    rows = sorted((r["doc_id"], r["text"], int(r["toxic"] > 0)) for r in rows)
    return train([r[1] for r in rows], np.array([r[2] for r in rows])) if rows else None


def _scorer(held, at: str, name: str):
    """Adds a column of scores to batches whose texts are in the column ``at``."""

    def scored(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        cache, rows = WordCache(80_000, 2_500_000), Rows((6 * HIDDEN,), np.float32)
        for batch in parts_of(found, 400):
            out = np.zeros(batch.num_rows)
            if model is not None:
                if cache.full():
                    cache.clear()
                    rows = Rows((6 * HIDDEN,), np.float32)
                flat, ends = list_parts(pc.ascii_split_whitespace(pc.utf8_lower(texts_of(batch, at))))
                coded = flat.dictionary_encode()
                numbers, new = cache.numbers(coded.dictionary.to_pylist())
                if new:
                    rows.add(model.projected(_clean(new)))
                start, size, of = windows(ends)
                logit = model.scores(rows.data, start, size, numbers[coded.indices.to_numpy()])
                out = sigmoid(np.maximum.reduceat(logit, np.searchsorted(of, np.arange(len(ends) - 1))).astype(np.float64)) if len(of) else out
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])

    return releasing(scored)


def score(docs: DataFrame, net: WindowNet | None) -> DataFrame:
    """doc_id, held_out, score, predicted of whole texts: all overlapping windows are scored, the largest counts.

    Null and empty texts are scored as a window without words; texts of any length are scored whole. A null doc_id isn't
    held out. Without a trained network all scores are 0. Repeated rows are rows, other columns, whatever their names,
    play no part, and an empty table gives an empty one.
    """
    batches(docs.sparkSession)
    out = id_and_text(docs).mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(net), "text", "score"), "doc_id long, text string, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, net: WindowNet | None) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text the network doesn't call toxic."""
    batches(docs.sparkSession)
    name = free_name(docs, "toxicity")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    text = next(c for c in docs.columns if c.lower() == "text")
    return docs.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(net), text, name), schema).where(F.col(name) < 0.5).select(*docs.columns)


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``score`` of all documents by a network that ``fit`` trains on the labels of documents that aren't held out."""
    return score(docs, fit(docs, labels))
