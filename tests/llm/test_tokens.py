import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import CASES

from starprism.llm import packing, tokenfiles
from starprism.llm.common import new_path
from starprism.llm.tokens import Encoder, tokenizer_path
from starprism.llm.wavelet import WaveletMatrix

ODD = ["", "  a  b ", "x\n\ny  z.", " lead", "trail ", "a\tb . c", "<|endoftext|> hi", "l'été d'or don't. I'll", "x  .", "É.", " \n ", "ab\x1c cd", "ǅ. 中文. ab", "naïve,, x", "İstanbul. K", "x\ny", "x.\nY z\n", "\nab", "x \ny", "q\r\nr s", "a\x85b c\x85 d", " x y  z", "ab　 \nq", "éa. ö", "\x00 a\x00b"]


def plain(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
@pytest.mark.parametrize("most", [2, 400_000])
def test_ids_are_the_tokenizers(name, spaces, most):
    r = random.Random(1)
    texts = ODD + [t or "" for _, t in CASES] + ["".join(r.choice(" \n\t.,ab'é0") for _ in range(r.randrange(40))) for _ in range(300)]
    coder = Encoder(tokenizer_path(name), spaces, most_words=most)
    for _ in range(2):
        ids, ends = coder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == plain(name, texts)
    assert len(coder.encode(pa.array([], pa.string()))[0]) == 0


def test_sum_of_squares_rule():
    """Each size goes where the sum of squares becomes smallest, checked against the definition."""
    r = random.Random(3)
    sizes = np.array([r.randrange(1, 20) for _ in range(300)])
    bins, offsets, gaps = packing.sum_of_squares(sizes, 20, freely=True)
    open_gaps: dict[int, int] = {}
    for s, b in zip(sizes.tolist(), bins.tolist(), strict=True):
        counts = {g: list(open_gaps.values()).count(g) for g in range(1, 21)}

        def total(place, s=s, counts=counts):
            n = dict(counts)
            if place != "new":
                n[place] -= 1
            rest = (20 if place == "new" else place) - s
            if rest:
                n[rest] = n.get(rest, 0) + 1
            return sum(v * v for g, v in n.items() if 0 < g < 20)

        options = [g for g in range(s, 20) if counts[g]] + ["new"]
        took = open_gaps.get(b, "new")
        assert total(took) == min(map(total, options))
        rest = (20 if took == "new" else took) - s
        open_gaps.pop(b, None)
        if rest:
            open_gaps[b] = rest
    for b in range(len(gaps)):
        own = sorted((o, s) for o, s, x in zip(offsets, sizes, bins, strict=True) if x == b)
        assert [o for o, _ in own] == np.cumsum([0] + [s for _, s in own])[:-1].tolist()
        assert gaps[b] == 20 - sum(s for _, s in own)


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist()
        assert sum(n for _, n in own) <= capacity
    return len(by)


def test_packing(spark, docs, empty):
    rows = packing.op1(docs).collect()
    got = sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for (i, _), ids in zip(CASES, plain("word_bpe_49k.json", [t or "" for _, t in CASES]), strict=True):
        ids = np.array([*ids, 1], "<u4")
        want += [(i or -1, a // 4096, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for a in range(0, len(ids), 4096)]
    assert got == sorted(want)
    check_packing(rows, 4096)
    assert packing.op1(empty).collect() == []


def test_packing_in_rounds(spark):
    r = random.Random(5)
    pieces = spark.createDataFrame([(i, 0, r.randrange(1, 101)) for i in range(3000)] + [(-1, 0, 100)] * 500, "doc_id long, piece int, length long")
    rows = packing.pack(pieces, 100, group=200, merge=4).collect()
    assert len(rows) == 3500
    gaps = []  # best fit, largest first
    for s in sorted((x.length for x in rows), reverse=True):
        i = min((i for i, g in enumerate(gaps) if g >= s), key=lambda i: gaps[i], default=None)
        if i is None:
            gaps.append(100 - s)
        else:
            gaps[i] -= s
    assert check_packing(rows, 100) <= 1.02 * len(gaps)


def test_wavelet_matrix():
    r = np.random.default_rng(1)
    for ids in (r.integers(0, 50_000, 3001), r.zipf(1.5, 2000) % 300, np.array([], np.int64), np.array([7]), np.array([70_000, 3])):
        m = WaveletMatrix(WaveletMatrix.build(np.asarray(ids, np.uint32), b"more"))
        assert m.extra == b"more" and m.decode().tolist() == list(ids)
        for i in r.integers(0, max(1, len(ids)), 20) if len(ids) else []:
            assert m.access(i) == ids[i]
            t = int(ids[i])
            where = np.flatnonzero(ids == t)
            assert m.rank(t, int(i)) == (where < i).sum() and m.count(t) == len(where)
            assert m.select(t, len(where) - 1) == where[-1] and m.occurrences(t)[:3] == where[:3].tolist()
    assert m.count(1 << 30) == 0
    with pytest.raises(ValueError, match="whole"):
        WaveletMatrix(WaveletMatrix.build(np.array([1, 2, 3], np.uint32))[:-1] + b"?")
    with pytest.raises(IndexError):
        m.access(2)


def test_wavelet_files_are_compressed_and_read_by_blocks():
    r = np.random.default_rng(2)
    ids = (r.zipf(1.3, 300_000) % 20_000).astype(np.uint32)
    data = WaveletMatrix.build(ids)
    assert len(data) < 2 * len(ids)  # less than two bytes an id
    m = WaveletMatrix(data)
    at = r.integers(0, len(ids), 500)
    assert (m.access_many(at) == ids[at]).all() and (m.decode() == ids).all()
    t = int(ids[5])
    where = np.flatnonzero(ids == t)
    for k in (0, len(where) // 2, len(where) - 1):
        assert m.select(t, k) == where[k]
    assert m.count(t, 1000, 200_000) == ((where >= 1000) & (where < 200_000)).sum()
    broken = WaveletMatrix(WaveletMatrix.build(np.array([5, 0, 7, 3], np.uint32)))
    with pytest.raises(ValueError, match="end"):
        tokenfiles.check_ends(broken, np.array([2, 2]))


def test_token_files(spark, docs, empty):
    rows = tokenfiles.op10(docs).collect()
    order = sorted(range(len(CASES)), key=lambda i: (CASES[i][0] is not None, CASES[i][0] or 0))
    ids = plain("byte_bpe_50k.json", [CASES[i][1] or "" for i in order])
    want, start = [], 0
    for i, x in zip(order, ids, strict=True):
        want.append((CASES[i][0], start, len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())))
        start += len(x) + 1
    assert sorted((r.doc_id or -1, r.start, r.n_tokens, r.ids_crc32) for r in rows) == sorted((a or -1, b, c, d) for a, b, c, d in want)
    assert tokenfiles.op10(empty).collect() == []


def test_token_files_in_small_shards(spark, docs):
    folder = new_path(spark, "small")
    shards = tokenfiles.write_token_files(docs, folder, tokenizer_path("byte_bpe_50k.json"), shard_ids=100, task_bytes=20_000)
    assert shards.count() > 5
    rows = sorted(tokenfiles.read_token_files(spark, folder, tokenfiles.shard_starts(shards, 2)).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known) and len(rows) == len(CASES)
