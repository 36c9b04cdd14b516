"""Near-duplicate groups by exact Jaccard similarity of word shingles; candidates by SimHash with multi-index hashing, and
by MinHash bands for pairs whose fingerprints differ in more bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starprism.llm.common import batches, checked, list_parts, materialize, pair_keys, parts_of, releasing, row_id_and_text, texts_of
from starprism.llm import simhash
from starprism.llm.components import connected, shuffled

SHINGLE_WORDS, SEED = 5, 42
#: A pair is near if 9 * common >= 4 * (n + m): Jaccard similarity of at least 4/5, in whole numbers.
_COMMON, _BOTH = 9, 4
#: A pair of similarity s shares no band with probability (1 - s**ROWS)**BANDS: 3e-6 at 0.8.
BANDS, ROWS = 32, 5
_R = np.random.default_rng(SEED)
_MULT, _PLUS = (_R.integers(0, 1 << 63, (BANDS * ROWS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(i) for i in (1, 0))


def shingles(texts: pa.Array, words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The distinct shingles of each text as sorted hashes; a shorter text is one shingle, one without words has none."""
    digest, join = xxhash.xxh64_intdigest, b" ".join
    flat, ends = list_parts(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    every = flat.cast(pa.binary()).to_pylist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        own = [w for w in every[a:b] if w]
        n = max(1, len(own) - words + 1) if own else 0
        yield np.unique(np.fromiter((digest(join(own[j : j + words]), SEED) for j in range(n)), np.uint64, n))


def least_hashes(found: np.ndarray) -> np.ndarray:
    """The MinHash signature of a set that isn't empty."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 2048):
        out = np.minimum(out, ((_MULT * found[at : at + 2048] + _PLUS) >> np.uint64(32)).min(axis=1))
    return out


def _set_id(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0


def _signed(rows: DataFrame) -> DataFrame:
    """rid, doc_id, set and sign (two hashes of the shingles), n (their number), fp (their SimHash) and bands, from rid,
    doc_id, text."""

    def signed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(found, 400):
            sets, sizes, prints, signatures = [], [], [], np.zeros((batch.num_rows, BANDS, ROWS), np.uint64)
            for i, own in enumerate(shingles(texts_of(batch))):
                sets.append(_set_id(own))
                sizes.append(len(own))
                prints.append(simhash.simhash(own))
                if len(own):
                    signatures[i] = least_hashes(own).reshape(BANDS, ROWS)
            size = np.array(sizes, np.int64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (batch.num_rows, BANDS))
            for i in range(ROWS):
                key = pair_keys(key, signatures[:, :, i])
            sign = np.zeros(batch.num_rows, np.uint64)
            for i in range(BANDS):
                sign = pair_keys(sign, key[:, i])
            offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(key[size > 0].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(sets, np.uint64).view(np.int64)), pa.array(sign.view(np.int64)), pa.array(size), pa.array(np.array(prints, np.uint64).view(np.int64)), bands], ["rid", "doc_id", "set", "sign", "n", "fp", "bands"])

    return rows.mapInArrow(releasing(signed), "rid long, doc_id long, set long, sign long, n long, fp long, bands array<long>")


def _neighbours(found: Iterator[pa.RecordBatch], back: int = 2) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that stand at most ``back`` rows apart in a bucket, from sorted key, node."""
    key, set_ = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in found:
        old = len(key)
        key, set_ = (np.concatenate([x, batch.column(i).to_numpy()]) for x, i in ((key, 0), (set_, 1)))
        for lag in range(1, min(back, len(key) - 1) + 1):
            at = np.flatnonzero(key[lag:] == key[:-lag]) + lag
            at = at[at >= old]
            x, y = set_[at], set_[at - lag]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
        key, set_ = key[-back:], set_[-back:]


def _print_pairs(marks: DataFrame) -> DataFrame:
    """Pairs a, b of nodes by SimHash: of one fingerprint, and of fingerprints that the multi-index links. Each
    fingerprint's first node stands for it."""
    prints = materialize(marks.where("n > 0").groupBy("fp").agg(F.min("node").alias("rep")), "prints")
    alike = marks.where("n > 0").select("fp", "node").join(shuffled(prints), "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    near = simhash.near_pairs(prints)
    for name in ("a", "b"):
        near = near.join(shuffled(prints.select(F.col("fp").alias(name), F.col("rep").alias(f"node_{name}"))), name)
    return alike.union(near.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")))


#: Bytes of a set's histogram: how many of its shingles have each value of their upper byte.
_CELLS = 256


def histogram(found: np.ndarray) -> bytes:
    return np.minimum(np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=_CELLS), 255).astype(np.uint8).tobytes()


def can_be_near(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles with these histograms (a row each) can reach the threshold. Common shingles fall in
    the same cell, so that the lesser counts bound them from above; what counts over 255 leave out is added."""
    most = np.minimum(x, y).sum(axis=1, dtype=np.int64) + np.minimum(n - x.sum(axis=1, dtype=np.int64), m - y.sum(axis=1, dtype=np.int64))
    return most * _COMMON >= _BOTH * (n + m)


def _likely(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs a, b that can be near, from a, b, n, m and histograms x, y."""
    cells = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _CELLS)
    for batch in found:
        near = can_be_near(cells(batch.column(4)), cells(batch.column(5)), batch.column(2).to_numpy(), batch.column(3).to_numpy())
        yield batch.select(["a", "b"]).filter(pa.array(near))


def _sets(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """rid, n, cells (the histogram) and own (the shingles, ascending) of the rows whose rid is in ``asked``."""

    def listed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(found, 400):
            own = list(shingles(texts_of(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([histogram(x) for x in own], pa.binary()), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], ["rid", "n", "cells", "own"])

    return materialize(rows.join(asked, "rid", "left_semi").select("rid", "text").mapInArrow(releasing(listed), "rid long, n long, cells binary, own array<long>"), "shingles")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b of rows whose similarity reaches the threshold, by their whole shingle sets. Only the sets of pairs
    whose histograms allow that are brought together."""
    brief = lambda rid, n, cells: sets.select(F.col("rid").alias(rid), F.col("n").alias(n), F.col("cells").alias(cells))
    both = pairs.join(brief("a", "n", "x"), "a").join(brief("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    likely = materialize(both.mapInArrow(releasing(_likely), "a long, b long"), "likely")
    wanted = checked(likely.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "wanted")
    sets = sets.join(wanted, "rid", "left_semi")
    met = likely.join(sets.select(F.col("rid").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("rid").alias("b"), F.col("own").alias("y")), "b")
    return materialize(met.where(_COMMON * F.size(F.array_intersect("x", "y")) >= _BOTH * (F.size("x") + F.size("y"))).select("a", "b"), "links")


#: Sets sampled to tell frequent shingles, and the most that are told. They only set the order; any order finds every pair.
SAMPLE, FREQUENT = 20_000, 100_000


def _frequent(sets: DataFrame, n_sets: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and their counts in the sample. So few pass the least count that the driver can hold them."""
    some = sets.where(F.pmod(F.xxhash64("rid"), F.lit(max(1, -(-n_sets // SAMPLE)))) == 0)
    least = max(2, -(-(some.agg(F.sum("n")).first()[0] or 0) // FREQUENT))
    found = some.select(F.explode("own").alias("token")).groupBy("token").count().where(F.col("count") >= least).toArrow()
    token, count = (found.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(token.view(np.uint64))
    return token.view(np.uint64)[order], count[order]


def prefix(found: np.ndarray, token: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A set's first shingles in the order of their counts (then as numbers), as many as can be the first common one with a
    near set no larger: with n - i shingles left from place i, 9 * (n - i) >= 4 * (n + m) for the least m, 4/5 of n."""
    n = len(found)
    at = np.searchsorted(token, found)
    known = at < len(token)
    known[known] = token[at[known]] == found[known]
    often = np.zeros(n, np.int64)
    often[known] = count[at[known]]
    return found[np.argsort(often, kind="stable")][: ((_COMMON - _BOTH) * n - _BOTH * -(-4 * n // 5)) // _COMMON + 1]


def _apart_pairs(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Candidates a, b among ``sets`` of different root (``roots``: rid, root; few enough are broadcast): all that can
    reach the threshold by their sizes and the places of a common shingle in their prefixes.

    All sets are sorted by one order of shingles, rare ones first. Of near sets, the first common shingle stands at places
    i and j with 9 * min(n - i, m - j) >= 4 * (n + m), so that it is in both prefixes. Texts that only have a frequent
    passage in common, however many, don't meet, since their prefixes hold their own shingles. Within a shingle's list a
    root's extremes are met first, then the members of those roots alone that can hold a near set."""
    token, count = _frequent(sets, roots.count())

    def posted(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(found, 400):
            flat, ends = list_parts(batch.column(2))
            own = flat.to_numpy().view(np.uint64)
            firsts = [prefix(own[a:b], token, count) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            sizes = np.array([len(x) for x in firsts], np.int64)
            at = np.concatenate([np.empty(0, np.int64), *map(np.arange, sizes)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *firsts]).view(np.int64)), pa.array(at), *(pa.array(np.repeat(batch.column(i).to_numpy(), sizes)) for i in (0, 1))], ["token", "i", "rid", "n"])

    posts = materialize(sets.select("rid", "n", "own").mapInArrow(releasing(posted), "token long, i long, rid long, n long").join(roots, "rid"), "postings")
    mixed = posts.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    posts = materialize(posts.join(checked(mixed, "mixed-tokens"), "token", "left_semi"), "mixed-postings")
    x = posts.select("token", F.col("rid").alias("x"), F.col("root").alias("r"), "n", "i")
    y = posts.where(f"{_COMMON} * i <= {_COMMON - 2 * _BOTH} * n").select("token", F.col("rid").alias("y"), F.col("root").alias("s"), F.col("n").alias("m"), F.col("i").alias("j"))
    there = y.groupBy("token", "s").agg(F.max(F.col("m") - F.col("j")).alias("left"), F.min("m").alias("low"), F.max("m").alias("high"))
    asked = x.join(shuffled(there), "token").where(f"r <> s and low <= n and 5 * high >= 4 * n and {_COMMON} * least(n - i, left) >= {_BOTH} * (n + low)").select("token", "x", "n", "i", "s")
    met = asked.join(shuffled(y), ["token", "s"]).where(f"(m < n or m = n and y < x) and {_COMMON} * least(n - i, m - j) >= {_BOTH} * (n + m)")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def kept_rows(docs: DataFrame, own: str) -> DataFrame:
    """rid of the row that stays of each group: that with the smallest doc_id, null last (of these the smallest row id).

    ``own`` is the column that tells the rows of ``docs`` apart (``common.with_row_id``). Texts are linked if their
    5-word shingles have a Jaccard similarity of 0.8 or more; groups are what links reach. A text that is null or blank
    has no shingles; all of these are one group. Rows of one set of shingles (by its size and two hashes, 128 bits)
    are one class, which its first row stands for. Candidates are op3's: SimHash fingerprints (of these shingles) within 4
    bits, by multi-index hashing. Texts of a similarity of 0.8 mostly differ in more bits (some 10), so that texts that
    share one of 32 bands are candidates, too: those next to each other in a bucket are compared at once with the former.
    Then the rows of buckets that hold several components are met by rare shingles (``_apart_pairs``), which finds every
    near pair of different components among them, so that neither a dense group nor a frequent passage is compared pair
    by pair.
    """
    batches(docs.sparkSession)
    rows = row_id_and_text(docs, own)
    signed = materialize(_signed(rows), "signatures")
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("rep")
    classes = signed.groupBy("set", "sign", "n").agg(first_row, F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    marks = materialize(classes.select(F.col("rep.rid").alias("node"), "n", "fp", "rep", "bands"), "sets")
    # two orders for all buckets: rows that share many buckets are mostly neighbours of the same rows in all of them
    order = F.xxhash64(F.pmod("key", F.lit(2)), "node").alias("o")
    each = marks.select("node", F.explode("bands").alias("key"))
    dealt = each.select("key", "node", order).repartitionByRange("key", "o").sortWithinPartitions("key", "o").select("key", "node")
    pairs = materialize(dealt.mapInArrow(releasing(_neighbours), "a long, b long").union(_print_pairs(marks)).distinct(), "candidates")
    asked = checked(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "asked")  # texts then aren't shuffled
    first = connected(marks.select("node"), _verified(pairs, _sets(rows, asked)))
    labelled = materialize(first, "labelled")  # node, root
    members = marks.join(labelled, "node").select("node", "root", F.explode("bands").alias("key"))
    mixed = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    meeting = checked(members.join(checked(mixed, "mixed-keys"), "key", "left_semi").select(F.col("node").alias("rid"), "root").distinct(), "mixed")
    sets = _sets(rows, meeting)
    links = _verified(materialize(_apart_pairs(sets, meeting), "candidates"), sets)
    of = lambda name: labelled.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
    joined = links.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
    tops = connected(labelled.select(F.col("root").alias("node")).distinct(), materialize(joined, "root-links")).select(F.col("node").alias("root"), F.col("root").alias("top"))
    # first within a root, then within a top: a huge group is summed before it is joined
    reps = labelled.join(marks.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("rep"))
    return checked(reps.join(tops, "root").groupBy("top").agg(F.min("rep").alias("rep")).select("rep.rid"), "kept")
