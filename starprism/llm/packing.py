"""Best-fit packing by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starprism.llm.common import batches, id_and_text, materialize, parts_of, releasing, texts_of
from starprism.llm.tokens import encoder, tokenizer_path

END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(sizes: np.ndarray, capacity: int, freely: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places sizes (1 to capacity), in the given order, where the sum over gaps of the squared number of open bins with
    that gap becomes smallest; ties go to the smallest gap. ``freely``: opening a bin is one of the places at any time,
    as the rule for sizes that come one by one has it; else a bin is opened only if no open one has room, which is
    better where all sizes are known. Returns each size's bin and offset, and each bin's gap."""
    cost = np.zeros(capacity + 1, np.float32)  # open bins by gap
    have = np.full(capacity + 1, -np.inf, np.float32)  # the same, and never where there is none
    cost[0] = -0.5  # a full bin counts nothing
    if freely:
        have[capacity] = 0.5  # a new bin was none before
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    change = np.empty(capacity + 1, np.float32)
    for i, s in enumerate(sizes.tolist()):
        n = capacity - s + 1
        g = int(np.subtract(cost[:n], have[s:], out=change[:n]).argmin()) + s
        if g == capacity or change[g - s] == np.inf:
            g, b = capacity, len(gaps)
            gaps.append(g)
        else:
            b = open_bins[g].pop()
            left = len(open_bins[g])
            cost[g] = left
            have[g] = left or -np.inf
        bins[i], offsets[i] = b, capacity - g
        gaps[b] = rest = g - s
        if rest:
            open_bins[rest].append(b)
            cost[rest] = have[rest] = len(open_bins[rest])
    return bins, offsets, np.array(gaps, np.int64)


def pack_group(sizes: np.ndarray, keys: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packs one group, largest first (of equals in the order of their keys, so that a repeated task packs alike)."""
    order = np.lexsort((keys, -sizes))
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    bins[order], offsets[order], gaps = sum_of_squares(sizes[order], capacity)
    return bins, offsets, gaps


def document_pieces(docs: DataFrame, path: str, capacity: int = 4096, ids: bool = False) -> DataFrame:
    """Token pieces of whole documents: the tokenizer's ids and the end id, cut every ``capacity`` ids. With ``ids`` a
    column holds each piece's ids. A null text counts as empty (one piece: the end id alone)."""

    def pieces(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, False, 150_000, 1_000_000)
        for batch in parts_of(found, 200):  # encoding takes many times a batch's bytes
            all_ids, ends = coder.encode(texts_of(batch))
            n = len(ends) - 1
            whole = np.insert(all_ids.astype("<u4"), ends[1:], END_ID)
            ends = ends + np.arange(n + 1)
            count = -(-np.diff(ends) // capacity)
            of = np.repeat(np.arange(n), count)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(np.diff(ends)[of] - start, capacity)
            first = ends[of] + start
            view = memoryview(np.ascontiguousarray(whole)).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(first.tolist(), length.tolist(), strict=True)]
            out = [batch.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(whole.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    batches(docs.sparkSession)
    return id_and_text(docs).mapInArrow(releasing(pieces, keeps=True), PIECES + (", ids array<int>" if ids else ""))


def _packer(names: list[str], capacity: int, round_no: int, pass_on: int):
    def packed(group: pa.Table) -> pa.Table:
        column = lambda name: group.column(name).to_numpy()
        bins, offsets, gaps = pack_group(column("length"), column("k"), capacity)
        count = np.bincount(bins, minlength=len(gaps))
        worst = np.argsort(-gaps, kind="stable")
        goes = np.zeros(len(gaps), bool)
        goes[worst[np.cumsum(count[worst]) <= pass_on]] = True
        kept = ~(goes & (gaps > 0))[bins]
        ids = (round_no << 56) | (column("g").astype(np.int64) << 32) | bins
        return group.select(names).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64())).append_column("kept", pa.array(kept))

    return packed


def pack(pieces: DataFrame, capacity: int = 4096, group: int = 16_000, merge: int = 16) -> DataFrame:
    """Gives every piece (doc_id, piece, length and more columns) a sequence_id and an offset.

    Pieces of the full length are sequences of their own. The others are dealt by hash to groups of about ``group``
    pieces and packed there by the sum-of-squares rule, each group in one task of bounded size. Of each group the bins
    with the largest gaps, up to a ``merge``-th of a group's pieces, go on to a next round with a ``merge``-th of the
    groups, so no group grows, until one group is left. Null ids and repeated ids are pieces like any other; an empty table gives none.
    """
    spark = pieces.sparkSession
    full = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": F.lit(1 << 62).cast("long") + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < capacity)
    total = rest.count()
    groups = max(1, -(-total // group))
    done, round_no = [], 0
    names = [f.name for f in pieces.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    while total:
        last = groups == 1

        keyed = rest.withColumn("k", F.xxhash64(F.lit(round_no), "doc_id", "piece", "length")).withColumn("g", F.pmod(F.col("k"), F.lit(groups)).cast("long"))
        out = materialize(keyed.groupBy("g").applyInArrow(_packer(names, capacity, round_no, 0 if last else group // merge), schema + ", sequence_id long, offset long, kept boolean"), f"packed-{round_no}")
        done.append(out.where("kept").drop("kept"))
        if last:
            break
        rest, groups, round_no = out.where("not kept").select(*names), max(1, -(-groups // merge)), round_no + 1
    for x in done:
        full = full.unionByName(x)
    return full


def op1(docs: DataFrame, path: str | None = None, capacity: int = 4096) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` ids; a row per piece."""
    pieces = materialize(document_pieces(docs, path or tokenizer_path("word_bpe_49k.json"), capacity), "pieces")
    return pack(pieces, capacity)
