"""Near-duplicate groups by SimHash with multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starprism.llm.common import batches, id_and_text, list_parts, materialize, texts_of
from starprism.llm.components import connected, salted_join, shuffled

SHINGLE_WORDS, SEED, DISTANCE = 4, 42, 4
#: Up to so many fingerprints three segments (46 probes each, keys of 21 bits) cost less than two (562 probes, 32 bits),
#: whose random matches per probe are a thousandth. Both find every link.
THREE_SEGMENTS = 20_000_000
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def simhash(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half the (unsigned 64-bit) hashes; 0 of none."""
    n = len(hashes)
    if not n:
        return 0
    lanes = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    if n < 200:
        counts = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of whole texts. A null or blank text has fingerprint 0."""

    def marked(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in found:
            flat, ends = list_parts(pc.ascii_split_whitespace(pc.ascii_lower(texts_of(batch))))
            every = flat.cast(pa.binary()).to_pylist()
            out = np.zeros(len(ends) - 1, np.uint64)
            for i in range(len(out)):
                own = every[ends[i] : ends[i + 1]]
                if own and not own[-1]:
                    own.pop()
                if own and not own[0]:
                    own.pop(0)
                if own:
                    n = max(1, len(own) - words + 1)
                    join = b" ".join
                    out[i] = simhash(np.fromiter((digest(join(own[j : j + words]), SEED) for j in range(n)), np.uint64, n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    batches(docs.sparkSession)
    return id_and_text(docs).mapInArrow(marked, "doc_id long, fp long")


def segments(distance: int, pieces: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment. Of fingerprints that differ in at most ``distance`` bits, some segment
    differs in at most its radius: were it not so, each segment would differ in radius + 1 bits, together over ``distance``."""
    low, more = divmod(distance, pieces)
    cuts = [64 * i // pieces for i in range(pieces + 1)]
    return [(a, b - a, low if i <= more else low - 1) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if i <= more or low > 0]


def ball(bits: int, radius: int) -> list[int]:
    """Every mask of at most ``radius`` of so many bits."""
    masks = [0]
    for _ in range(radius):
        masks = sorted({m | 1 << i for m in masks for i in range(bits)} | set(masks))
    return masks


def _key(fp, first: int, bits: int):
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1)).cast("long")


def _ball_keys(seg: int, first: int, bits: int, radius: int):
    """The keys of a segment's Hamming ball, as an array of (seg, key)."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball(bits, radius)])
    return F.transform(masks, lambda m: F.struct(F.lit(seg).alias("seg"), _key(F.col("fp"), first, bits).bitwiseXOR(m).alias("key")))


def _runs(distance: int, back: int = 8):
    """Links within sorted runs: each fingerprint is linked to the nearest before it, of ``back``, that is near."""

    def linked(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, seg = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in found:
            old = len(fp)
            fp, seg = (np.concatenate([x, batch.column(i).to_numpy()]) for x, i in ((fp, 1), (seg, 2)))
            to = np.full(len(fp), -1)
            for lag in range(min(back, len(fp) - 1), 0, -1):
                near = (np.bitwise_count((fp[lag:] ^ fp[:-lag]).view(np.uint64)) <= distance) & (seg[lag:] == seg[:-lag])
                to[lag:][near] = np.flatnonzero(near)
            at = old + np.flatnonzero(to[old:] >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[to[at]])], ["a", "b"])
            fp, seg = fp[-back:], seg[-back:]

    return linked


def _multi_index(marks: DataFrame, distance: int, pieces: int | None, crowd: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links that join all fingerprints fp of ``marks`` which links of ``distance`` reach: those of the first pass (a, b),
    the first pass's components (fp, root), and links between these (root, other, fp, fp2).

    Exact, by multi-index hashing with two passes that spare dense groups from comparing all pairs:
    1. the fingerprints, sorted by each segment, are linked to near neighbours in that order, which joins most of a
       dense group by few links. No row is tied to a task by its key here, so one huge group is dealt to many tasks;
    2. each fingerprint enumerates the Hamming balls of its segments, fetches the table matches under these keys and
       verifies all 64 bits, for matches of another component alone: links within one tell nothing new. Under keys
       with over ``crowd`` fingerprints it fetches the components' labels first, then only the members of others.
    """
    cut = segments(distance, pieces or (3 if marks.count() <= THREE_SEGMENTS else 2))
    tables = lambda df, *more: df.select(*more, "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), _key(F.col("fp"), a, n).alias("key")) for i, (a, n, _) in enumerate(cut)])).alias("t")).select(*more, "fp", "t.seg", "t.key")
    sorted_ = tables(marks).repartitionByRange("seg", "key", "fp").sortWithinPartitions("seg", "key", "fp").select("key", "fp", "seg")
    chained = materialize(sorted_.mapInArrow(_runs(distance), "a long, b long").distinct(), "chains")
    first = connected(marks.select(F.col("fp").alias("node")), chained)
    labelled = materialize(marks.select("fp").join(shuffled(first.withColumnRenamed("node", "fp")), "fp"), "labelled")  # fp, root
    stored = materialize(tables(labelled, "root"), "tables")
    keys = [_ball_keys(i, *x) for i, x in enumerate(cut)]
    probes = labelled.select("fp", "root", F.explode(F.concat(*keys)).alias("t")).select("fp", "root", "t.seg", "t.key")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= distance
    apart = F.col("root") != F.col("other")
    members = shuffled(stored.select("seg", "key", F.col("root").alias("other"), F.col("fp").alias("fp2")))
    crowded = materialize(stored.groupBy("seg", "key").count().where(F.col("count") > crowd).select("seg", "key"), "crowded")
    if crowded.take(1):
        few = members.join(crowded, ["seg", "key"], "left_anti")
        many = shuffled(probes).join(crowded, ["seg", "key"], "left_semi")
        labels_there = members.join(crowded, ["seg", "key"], "left_semi")
        asked = many.join(shuffled(labels_there.select("seg", "key", "other").distinct()), ["seg", "key"]).where(apart)
        pairs = probes.join(shuffled(few), ["seg", "key"]).where(apart & near).select("root", "other", "fp", "fp2").union(asked.join(shuffled(labels_there), ["seg", "key", "other"]).where(near).select("root", "other", "fp", "fp2"))
    else:
        pairs = probes.join(members, ["seg", "key"]).where(apart & near).select("root", "other", "fp", "fp2")
    return chained, labelled, pairs


def near_pairs(marks: DataFrame, distance: int = DISTANCE, pieces: int | None = None, crowd: int = 1000) -> DataFrame:
    """Pairs a, b of near fingerprints that join all which links reach (not every pair of a dense group)."""
    chained, _, pairs = _multi_index(marks, distance, pieces, crowd)
    return chained.union(pairs.groupBy("root", "other").agg(F.min("fp").alias("a"), F.min_by("fp2", "fp").alias("b")).select("a", "b"))


def near_links(marks: DataFrame, distance: int = DISTANCE, pieces: int | None = None, crowd: int = 1000) -> DataFrame:
    """Component per fingerprint: fp, label (the smallest ``rep`` of its component). ``marks``: distinct fp with rep."""
    _, labelled, pairs = _multi_index(marks, distance, pieces, crowd)
    links = materialize(pairs.select(F.col("root").alias("a"), F.col("other").alias("b")).distinct(), "links")
    roots = materialize(labelled.select(F.col("root").alias("node")).distinct(), "roots")
    second = connected(roots, links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    # labels are summed within roots first; what is joined by a root is dealt by the fingerprint too
    reps = materialize(labelled.join(shuffled(marks), "fp").groupBy("root").agg(F.min("rep").alias("rep")).join(shuffled(second), "root"), "root-reps")
    tops = reps.groupBy("top").agg(F.min("rep").alias("label"))
    named = salted_join(reps, tops, "top", "root").select("root", "label")
    return salted_join(labelled, named, "root", "fp").select("fp", "label")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, distance: int = DISTANCE) -> DataFrame:
    """A row per document: doc_id, fingerprint (hex), component_id (the smallest doc_id that links reach).

    Documents of one fingerprint are one class, so copies are never paired. Texts without words (null, empty, white
    space) have fingerprint zero and are linked like any other. A null doc_id gets a row and never names a component
    unless no other id is there (component_id is then null). Repeated rows are rows. Texts of any length are read whole.
    Other columns, whatever their names, play no part. An empty table gives an empty one.
    """
    marked = materialize(fingerprints(docs, words), "fingerprints")
    marks = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "marks")
    label = materialize(near_links(marks, distance), "labels")
    return salted_join(marked.withColumn("place", F.monotonically_increasing_id()), label, "fp", "place").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("label").alias("component_id"))
