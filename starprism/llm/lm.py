"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

One plan for every size: each batch of documents sends its distinct n-grams once, dealt by hash to groups of bounded size;
a group sums the training counts, fills its stretch of the filter and answers every batch's membership probes against it;
the answers go back to the batches, which turn them into smoothed probabilities. So no worker ever holds more of the
filter than one group's stretch, and nothing that grows with the corpus is broadcast or gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starprism.llm.common import Rows, batches, id_and_text, list_parts, materialize, mix, new_path, pair_keys, remainder, texts_of

END = np.uint64(xxhash.xxh64_intdigest(b" ", 0))  # no word holds a space
BASE = 1.5  # counts are kept as whole powers of it
BLOCK_BITS = 1 << 19  # all probes of a key fall into one block
BITS_EACH, PROBES = 12, 6  # bits for each stored level, positions for each
STRENGTH = 4.0  # how many tokens the next shorter context's estimate counts as
#: A group holds about so many n-grams. Within a group they are told apart by 40 bits of their hash: with a bounded number
#: of them a wrong match is far rarer than a false positive of the filter. Words are told apart by all 64 bits.
GROUP_GRAMS, GRAM_BITS = 2_000_000, 40

_U = np.uint64


def level_of(counts: np.ndarray) -> np.ndarray:
    """The quantised count, from 1: how many powers of ``BASE`` the count holds."""
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: its lowest whole count, 0 for level 0."""
    return np.where(level > 0, np.ceil(BASE ** (level - 1.0) - 1e-9), 0.0)


class Tokens:
    """Tokens of whole texts as hashes, with each distinct word hashed once while it is cached."""

    def __init__(self, most_words: int = 150_000):
        self.most_words = most_words
        self._reset()

    def _reset(self) -> None:
        self.kept, self.hashes = pa.array([], pa.string()), Rows((), np.uint64)

    def _hashes(self, words: pa.Array) -> np.ndarray:
        """Hash of each distinct word. Those that come first are kept, up to a bound; if most are new, the kept ones go."""
        found = pc.index_in(words, value_set=self.kept).fill_null(-1).to_numpy()
        new = found < 0
        if new.sum() > 0.7 * len(new) and len(self.kept) > self.most_words // 2:
            self._reset()
            new = np.ones(len(new), bool)
        out = np.empty(len(words), np.uint64)
        out[~new] = self.hashes.data[found[~new]]
        fresh = words.filter(pa.array(new))
        digest = xxhash.xxh64_intdigest
        out[new] = np.fromiter((digest(w, 0) for w in fresh.cast(pa.binary()).to_pylist()), np.uint64, len(fresh))
        if len(self.kept) + len(fresh) <= self.most_words:
            self.kept = pa.concat_arrays([self.kept, fresh])
            self.hashes.add(out[new])
        return out

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tokens as hashes (words in lower-case A-Z; the last is the end; one may have no place), each token's number among them (one
        end after each text), where each text's tokens begin with the end last, and which tokens are ends."""
        flat, ends = list_parts(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
        coded = flat.dictionary_encode()
        which = coded.indices.to_numpy()
        empty = np.flatnonzero(pc.equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False))
        if len(empty):  # what stands before and after white space at a text's ends is no word
            real = which != empty[0]
            ends = np.concatenate([[0], np.cumsum(real)])[ends]
            which = which[real]
        some = np.append(self._hashes(coded.dictionary), END)
        which = np.insert(which, ends[1:], len(some) - 1)
        ends = ends + np.arange(len(ends))
        last = np.zeros(len(which), bool)
        last[ends[1:] - 1] = True
        return some, which, ends, last


def _shifted(word: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The token before each; an end stands before each text's first."""
    out = np.empty_like(word)
    out[1:] = word[:-1]
    out[heads] = END
    return out


def grams(word: np.ndarray, heads: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and triples of a batch as group << GRAM_BITS | key, sorted; each token's pair and triple among them.
    A text's first token has no triple (its pair stands in)."""
    before = _shifted(word, heads)
    pair = pair_keys(before, word)
    triple = pair_keys(pair_keys(_shifted(before, heads) ^ _U(0xA5A5A5A5A5A5A5A5), before), word)
    triple[heads] = pair[heads]
    every = np.concatenate([pair, triple])
    every = ((every >> _U(GRAM_BITS)) % _U(n_groups)) << _U(GRAM_BITS) | every & _U((1 << GRAM_BITS) - 1)
    found, at = np.unique(every, return_inverse=True)
    return found, at[: len(word)], at[len(word) :]


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of unsigned values, byte by byte of equal rank, which compresses sorted and small ones."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _values(data: bytes, width: int) -> np.ndarray:
    parts = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((parts.shape[1], 8), np.uint8)
    out[:, :width] = parts.T
    return out.view("<u8").reshape(-1)


class LogBloom:
    """Log-frequency Bloom filter: a key of level q is stored as the items (key, 1) to (key, q). A lookup probes level
    after level and stops at the first that is missing, so it never tells less than was stored, and each level too many
    takes one more false positive."""

    def __init__(self, data: np.ndarray):
        self.data, self.n_blocks = data, 8 * len(data) // BLOCK_BITS

    @classmethod
    def build(cls, keys: np.ndarray, levels: np.ndarray) -> LogBloom:
        n_blocks = max(1, -(-int(levels.sum()) * BITS_EACH // BLOCK_BITS))
        bits = np.zeros(n_blocks * BLOCK_BITS, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            keys, levels = keys[levels >= level], levels[levels >= level]
            base, (at, step) = cls._block(keys, n_blocks), cls._steps(keys, level)
            for _ in range(PROBES):
                bits[base + at] = True
                at = (at + step) & (BLOCK_BITS - 1)
        return cls(np.packbits(bits, bitorder="little"))

    @staticmethod
    def _block(keys: np.ndarray, n_blocks: int) -> np.ndarray:
        """The first bit of each key's block."""
        return ((keys >> _U(24)) % _U(n_blocks)).astype(np.int64) * BLOCK_BITS

    @staticmethod
    def _steps(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and step of a key's probes for a level; probe i goes to (start + i * step) modulo the block's bits."""
        with np.errstate(over="ignore"):
            h = mix(keys + _U(level) * _U(0xD6E8FEB86659FD93))
        return (h & _U(BLOCK_BITS - 1)).astype(np.int32), ((h >> _U(40)) | _U(1)).astype(np.int32) & (BLOCK_BITS - 1)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Each key's level, 0 if it isn't stored."""
        out, alive, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
        base = self._block(keys, self.n_blocks)
        while len(alive):  # one more level for the keys that hold all levels so far
            level += 1
            at, step = self._steps(keys, level)
            for _ in range(PROBES):  # most absent keys go at the first probe
                bit = base + at
                hit = (self.data[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 != 0
                if not hit.all():
                    alive, base, keys, at, step = (x[hit] for x in (alive, base, keys, at, step))
                at = (at + step) & (BLOCK_BITS - 1)
            out[alive] = level
        return out


def tokenized(docs: DataFrame) -> DataFrame:
    """A row per batch of documents (doc_id, text, asked, train), written: batch, tokens, what its documents are, the hashes of its
    distinct words, sorted, and each token's place among them."""

    def batch_rows(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, base = Tokens(), TaskContext.get().partitionId() << 32
        for i, batch in enumerate(found):
            some, which, ends, _ = tokens.of(texts_of(batch))
            used, back = np.unique(some[which], return_inverse=True)
            width = 2 if len(used) <= 1 << 16 else 4
            common = np.argsort(-np.bincount(back, minlength=len(used)), kind="stable")  # small numbers for common words
            number = np.empty(len(used), np.int64)
            number[common] = np.arange(len(used))
            one = lambda x, t: pa.array([x], t)
            yield pa.RecordBatch.from_pydict({
                "batch": one(base + i, pa.int64()), "tokens": one(len(which), pa.int64()), "doc_ids": pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                "asked": one(np.asarray(batch.column(2).to_numpy(zero_copy_only=False), np.uint8).tobytes(), pa.binary()), "train": one(np.asarray(batch.column(3).to_numpy(zero_copy_only=False), np.uint8).tobytes(), pa.binary()),
                "ends": one(ends.astype("<i8").tobytes(), pa.binary()), "words": one(used[common].astype("<u8").tobytes(), pa.binary()), "which": one(_planes(number[back].astype(np.uint64), width), pa.binary()),
            })

    path = new_path(docs.sparkSession, "tokens")
    schema = "batch long, tokens long, doc_ids array<long>, asked binary, train binary, ends binary, words binary, which binary"
    docs.select("doc_id", "text", "asked", "train").mapInArrow(batch_rows, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def _batch(row: dict, n_groups: int) -> tuple:
    """Of a stored batch: ends, the words in the order of their groups with their group and each token's place among them, and grams()."""
    ends = np.frombuffer(row["ends"], "<i8")
    words = np.frombuffer(row["words"], "<u8")
    width = len(row["which"]) // max(1, int(ends[-1]))
    which = _values(row["which"], width).astype(np.int64) if int(ends[-1]) else np.zeros(0, np.int64)
    group = ((words >> _U(GRAM_BITS)) % _U(n_groups)).astype(np.int64)
    order = np.lexsort((words, group))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    which = place[which]
    words, group = words[order], group[order]
    return ends, words, group, which, *grams(words[which], ends[:-1], n_groups)


_SENT = "g int, batch long, words binary, word_n binary, grams binary, gram_n binary"
_ANSWER = "batch long, g int, word_count binary, word_level binary, gram_level binary, n long, v long"


def _questions(n_groups: int):
    """A row per batch and group: the batch's distinct words and n-grams there, with their counts in training texts."""

    def asked(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in found:
            for row in rows.to_pylist():
                ends, words, group, which, some, pair, triple = _batch(row, n_groups)
                trains = np.repeat(np.frombuffer(row["train"], np.uint8) > 0, np.diff(ends))
                first = np.repeat(ends[:-1], np.diff(ends)) == np.arange(len(which))
                word_n = np.bincount(which[trains], minlength=len(words)).astype(np.uint64)
                gram_n = (np.bincount(pair[trains], minlength=len(some)) + np.bincount(triple[trains & ~first], minlength=len(some))).astype(np.uint64)
                cut_w = np.searchsorted(group, np.arange(n_groups + 1))
                cut_g = np.searchsorted(some, np.arange(n_groups + 1, dtype=np.uint64) << _U(GRAM_BITS))
                for g in range(n_groups):
                    w, x = slice(cut_w[g], cut_w[g + 1]), slice(cut_g[g], cut_g[g + 1])
                    if w.stop > w.start or x.stop > x.start:
                        yield pa.RecordBatch.from_pydict({
                            "g": pa.array([g], pa.int32()), "batch": pa.array([row["batch"]], pa.int64()), "words": [words[w].tobytes()], "word_n": [_planes(word_n[w], 4)], "grams": [_planes(some[x], 5)], "gram_n": [_planes(gram_n[x], 4)],
                        })

    return asked


def _answers(group: pa.Table) -> pa.Table:
    """Sums a group's counts, fills its stretch of the filter, and answers every batch's probes against it."""
    rows = {n: group.column(n).to_pylist() for n in ("g", "batch", "words", "word_n", "grams", "gram_n")}
    words, word_at = np.unique(np.concatenate([np.frombuffer(x, "<u8") for x in rows["words"]]), return_inverse=True)
    word_n = np.bincount(word_at, np.concatenate([_values(x, 4) for x in rows["word_n"]]), len(words)).astype(np.int64)
    some, gram_at = np.unique(np.concatenate([_values(x, 5) for x in rows["grams"]]), return_inverse=True)
    gram_n = np.bincount(gram_at, np.concatenate([_values(x, 4) for x in rows["gram_n"]]), len(some)).astype(np.int64)
    keys, n = np.concatenate([mix(words ^ _U(1)), mix(some << _U(2) ^ _U(2))]), np.concatenate([word_n, gram_n])
    bloom = LogBloom.build(keys[n > 0], level_of(n[n > 0]))
    level = bloom.levels(keys).astype(np.uint8)
    word_level, gram_level = level[: len(words)][word_at], level[len(words) :][gram_at]
    word_count = word_n[word_at]
    cut_w = np.cumsum([0, *(len(x) // 8 for x in rows["words"])])
    cut_g = np.cumsum([0, *(len(x) // 5 for x in rows["grams"])])
    each = range(len(rows["g"]))
    once = lambda x: pa.array([int(x), *[0] * (len(rows["g"]) - 1)], pa.int64())
    return pa.table({
        "batch": pa.array(rows["batch"], pa.int64()), "g": pa.array(rows["g"], pa.int32()), "word_count": pa.array([_planes(word_count[cut_w[i] : cut_w[i + 1]].astype(np.uint64), 8) for i in each], pa.binary()),
        "word_level": pa.array([word_level[cut_w[i] : cut_w[i + 1]].tobytes() for i in each], pa.binary()), "gram_level": pa.array([gram_level[cut_g[i] : cut_g[i + 1]].tobytes() for i in each], pa.binary()), "n": once(word_n.sum()), "v": once((word_n > 0).sum()),
    })


def probabilities(words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, ends: np.ndarray, n: int, v: int) -> np.ndarray:
    """Each token's probability from the levels of its word, pair and triple: a context's counts are smoothed by the next
    shorter context's estimate, which counts as ``STRENGTH`` tokens, so a context never met leaves that estimate alone
    (back-off). Words have the add-one estimate; the token before a text's first is an end, and it has no triple."""
    heads = ends[:-1]
    word, pair, triple = count_of(words), count_of(pairs), count_of(triples)
    before, two = np.empty_like(word), np.empty_like(word)
    before[1:], two[1:] = word[:-1], pair[:-1]
    before[heads], two[heads] = word[ends[1:] - 1], 0.0  # a text's last token is an end
    triple = np.where(two > 0, triple, 0.0)
    triple[heads] = 0.0
    single = np.minimum(1.0, (word + 1) / (n + v + 1))
    second = (np.minimum(pair, before) + STRENGTH * single) / (before + STRENGTH)
    return (np.minimum(triple, two) + STRENGTH * second) / (two + STRENGTH)


def _scores(n_groups: int, n: int, v: int):
    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        right = right.sort_by("g")
        joined = lambda name: b"".join(right.column(name).to_pylist())
        for row in left.to_pylist():
            ends, _, _, which, _, pair, triple = _batch(row, n_groups)
            count = np.concatenate([np.zeros(0, np.uint64), *(_values(x, 8) for x in right.column("word_count").to_pylist() if x)]).astype(np.int64)[which]
            word_level, gram_level = (np.frombuffer(joined(x), np.uint8).astype(np.int64) for x in ("word_level", "gram_level"))
            p = probabilities(word_level[which], gram_level[pair], gram_level[triple], ends, n, v)
            sums = lambda x: np.add.reduceat(x, ends[:-1]) if len(ends) > 1 else np.zeros(0)
            made = pa.table({
                "doc_id": pa.array(row["doc_ids"], pa.int64()), "n_tokens": pa.array(np.diff(ends), pa.int64()), "n_known": pa.array(sums((count > 0).astype(np.int64)), pa.int64()),
                "base_score": pa.array(sums(np.log10((count + 1) / (n + v + 1))), pa.float64()), "score": pa.array(sums(np.log10(p)), pa.float64()),
            })
            out.append(made.filter(pa.array(np.frombuffer(row["asked"], np.uint8) > 0)))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], t) for c, t in (("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})

    return scored


def score(docs: DataFrame, train: Column, training: DataFrame | None = None) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. The model learns from the
    documents for which ``train`` is true, and from those of ``training`` where it is given.

    Null texts are empty: one end token. Repeated rows are rows and train as often; texts of any length are read whole.
    Without training texts every word is unknown and each token's probability follows from the formulas. Other columns,
    whatever their names, play no part. Words are counted by 64-bit hash. Nothing here depends on the corpus's size but
    the number of groups.
    """
    spark = docs.sparkSession
    batches(spark)
    rows = id_and_text(docs).withColumns({"asked": F.lit(True), "train": F.coalesce(train, F.lit(False))})
    if training is not None:
        rows = rows.union(id_and_text(training).withColumns({"asked": F.lit(False), "train": F.lit(True)}))
    held = tokenized(rows)
    total = held.agg(F.sum("tokens")).first()[0] or 0
    n_groups = max(1, -(-2 * int(total) // GROUP_GRAMS))
    sent = held.mapInArrow(_questions(n_groups), _SENT)
    answers = materialize(sent.groupBy("g").applyInArrow(_answers, _ANSWER), "levels")
    n, v = (int(x or 0) for x in answers.agg(F.sum("n"), F.sum("v")).first())
    out = held.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_scores(n_groups, n, v), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    hidden = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out")
    return out.select("doc_id", hidden, "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op9(docs: DataFrame) -> DataFrame:
    """``score`` of all documents, learning from those whose crc32(doc_id) mod 7 is not 2; a null id isn't held out and
    trains nothing. Empty tables give no rows."""
    return score(docs, remainder(F.col("doc_id").cast("long"), 7) != 2)
