import base64
import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
from tests.llm.conftest import CASES, prose

from starprism.llm import decontamination, topk, warc
from starprism.llm.common import new_path

PAGES = [(5, "http://a/ä b", "<p>x</p>"), (3, None, "<p>x</p>"), (9, "u", None), (2, "u", ""), (7, "u", "ünï" * 5000), (None, "u", "<p>x</p>"), (11, "u", "only"), (11, "u", "only"), (None, "u", "null id alone"), (4, "u\r\nX: y", "WARC/1.1\r\nWARC-Type: response\r\n\r\n")]


def test_archives(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, payload int")
    rows = warc.op2(pages).collect()
    data = [(i, (h or "").encode()) for i, _, h in PAGES]
    want = []
    for i, d in data:
        first = min((j for j, e in data if e == d and j is not None), default=None)
        revisit = first is not None and i != first
        want.append((i, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert warc.op2(pages.limit(0)).collect() == []
    folder = new_path(spark, "warc-test")
    warc.write_archives(pages, folder, least_bytes=5)
    got = warc.read_archives(spark, folder, payloads=True)
    gaps = got.where("reason IS NOT NULL")
    assert {r.page_id: bytes(r.payload).decode() for r in got.collect() if r.page_id in (7, 4)} == {7: PAGES[4][2], 4: PAGES[9][2]}
    assert {r.record_type for r in got.where("page_id in (9, 2)").collect()} == {"response"} and gaps.count() == 0


def test_salvage_after_damage():
    records = [warc.record(i, "u", f"page {i} ".encode() * 50) for i in range(8)]
    members = [gzip.compress(r) for r in records]
    whole = b"".join(members)
    ids = lambda s: [h["warc-record-id"] for h, _ in s.records]
    every = [f"<urn:x-page:{i}>" for i in range(8)]
    assert ids(warc.salvage(whole)) == every and warc.salvage(whole).gaps == []
    start = sum(map(len, members[:3]))
    broken = bytearray(whole)
    broken[start + 40] ^= 0xFF
    got = warc.salvage(bytes(broken))
    assert ids(got) == every[:3] + every[4:] and [(a, b) for a, b, _ in got.gaps] == [(start, start + len(members[3]))]
    assert ids(warc.salvage(whole[5:])) == every[1:]
    cut = warc.salvage(whole[:-9])  # the last record is whole, its member's checksum isn't
    assert ids(cut) == every and [(a, b) for a, b, _ in cut.gaps] == [(len(whole) - len(members[7]), len(whole) - 9)]
    assert ids(warc.salvage(whole[:-30])) == every[:-1]
    noise = b"\x1f\x8b\x08garbage" + whole[:start] + b"\x00" * 100 + whole[start:]
    assert ids(warc.salvage(noise)) == every and sum(b - a for a, b, _ in warc.salvage(noise).gaps) == 110
    plain = b"".join(records)
    at = len(records[0]) + 30
    got = warc.salvage(plain[:at] + b"?" + plain[at:])
    assert len(got.records) in (7, 8) and warc.salvage(plain).gaps == []
    cut = plain[: len(records[0]) + 100] + plain[len(records[0]) + 150 :]
    assert ids(warc.salvage(cut)) == every[:1] + every[2:] and len(warc.salvage(cut).gaps) == 1
    assert warc.salvage(b"").records == [] and warc.salvage(b"nothing here").gaps == [(0, 12, "no version line")]
    one = gzip.compress(plain[: len(records[0])] + b"junk" + plain[len(records[0]) :])
    assert ids(warc.salvage(one)) == every and len(warc.salvage(one).gaps) == 1


def test_damage_in_one_member_and_in_mixed_archives():
    records = [warc.record(i, "u", random.Random(i).randbytes(3000)) for i in range(8)]
    ids = lambda s: [h["warc-record-id"] for h, _ in s.records]
    every = [f"<urn:x-page:{i}>" for i in range(8)]
    one = gzip.compress(b"".join(records))
    cut = warc.salvage(one[: len(one) // 2])  # the records before the cut are read and checked
    assert ids(cut) == every[: len(cut.records)] and 2 <= len(cut.records) <= 4 and cut.gaps[-1][1] == len(one) // 2
    after = warc.salvage(one[: len(one) // 2] + records[6] + gzip.compress(records[7]))  # a plain record after damage
    assert ids(after) == [*ids(cut), every[6], every[7]] and after.gaps[-1][1] == len(one) // 2


def test_reading_takes_time_in_proportion():
    import time

    def seconds(n):
        data = b"".join(gzip.compress(warc.record(i, "u", random.Random(i).randbytes(8000)), 1) for i in range(n))
        began = time.process_time()
        got = warc.salvage(data)
        assert len(got.records) == n and not got.gaps
        return time.process_time() - began

    short, long = seconds(500), seconds(4000)
    assert long < 8 * 3 * max(short, 0.02)


def test_gaps_come_with_the_records(spark):
    from starprism.llm.files import write_file

    folder = new_path(spark, "warc-gaps")
    members = [gzip.compress(warc.record(i, "u", b"page" * 100)) for i in range(4)]
    write_file(f"{folder}/a.warc.gz", members[0] + b"\0" * 50 + members[1])
    write_file(f"{folder}/b.warc.gz", b"".join(members[2:]))
    rows = warc.read_archives(spark, folder).collect()
    assert sorted(r.page_id for r in rows if r.reason is None) == [0, 1, 2, 3]
    assert [(r.name, r.gap_start, r.gap_end) for r in rows if r.reason] == [("a.warc.gz", len(members[0]), len(members[0]) + 50)]


def hits_by_force(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, ids = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(8, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            for p in range(len(own) - n + 1):
                if own[p : p + n] == w[s : s + n] and item is not None:
                    hit |= set(range(p, p + n))
                    ids.add(str(item))
    return len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(ids) >= 2


def test_decontamination(spark, docs, empty):
    long = prose(30, 77)
    items = [(1, prose(30, 2)), (2, long), (30, "One"), (4, None), (None, long), (5, "Straße İSTANBUL"), (6, prose(12, 8)), (6, prose(12, 8)), (7, "x y x y x y x y x y x y"), (8, "...")]
    more = [(100, "start " + long + " middle " + prose(12, 8) + " end"), (101, "x y " * 30), (102, " ".join(long.split()[:7])), (103, long + " " + long.upper()), (104, prose(700, 5) + " " + long), (105, "STRASSE straße-İSTANBUL"), (None, long), (103, "other text")]
    rows = CASES + more
    made = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, k int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = sorted((tuple(r)[:6] for r in decontamination.decontaminate(made, bench).collect()), key=str)
    want = sorted(((i, *hits_by_force(t, items)) for i, t in rows), key=str)
    assert got == want
    assert decontamination.decontaminate(empty, bench).collect() == []
    assert all(r.n_items == 0 for r in decontamination.decontaminate(made, bench.limit(0)).collect())


def test_random_phrases(spark):
    r = random.Random(6)
    word = lambda: r.choice("abc")
    docs = [(i, " ".join(word() for _ in range(r.randrange(0, 60)))) for i in range(60)]
    items = [(i, " ".join(word() for _ in range(r.randrange(0, 12)))) for i in range(40)]
    made = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (decontamination.BROADCAST_ROWS, 1):  # with small sides broadcast, and with everything joined by a shuffle
        got = sorted(map(tuple, decontamination.decontaminate(*made, most=most).collect()))
        assert [g[:6] for g in got] == sorted((i, *hits_by_force(t, items)) for i, t in docs)
        assert {g[0]: g[6] for g in got} == near_by_force(docs, items)


def near_by_force(docs, items, slop=8, rare=3):
    own = {i: t.split() for i, t in docs}
    places = Counter(w for ws in own.values() for w in ws)
    out = {i: 0 for i, _ in docs}
    for i, ws in own.items():
        for words in {tuple(t.split()) for _, t in items}:
            terms = sorted((places[w], words.index(w), w) for w in set(words) if places[w])[:rare]
            shifts = [[p - at for p, x in enumerate(ws) if x == w] for _, at, w in terms]
            near = any(abs(x - y) <= slop for j in range(len(shifts)) for k in range(j) for x in shifts[j] for y in shifts[k])
            out[i] += near * len({n for n, t in items if tuple(t.split()) == words})
    return out


def test_index_holds_every_place(spark):
    docs = spark.createDataFrame([(7, 1, "a b, a"), (8, None, None)], "rid long, doc_id long, text string")
    items = decontamination.item_words(spark.createDataFrame([(1, "A c")], "item_id long, text string"))
    terms = decontamination.vocabulary(items)
    number = {r.name: r.term for r in terms.collect()}
    for most in (0, 100):
        index = decontamination.positional_index(docs, terms, most)
        assert sorted(map(tuple, index.collect()), key=str) == sorted([(number["a"], 7, 0, None), (number["a"], 7, 2, None), (-1, 7, 3, 1), (-1, 8, 0, None)], key=str)
        assert decontamination.term_counts(index).collect() == [(number["a"], 2)]


def test_proximity(spark):
    docs = [(1, "zebra one two quokka three"), (2, "zebra " + "filler " * 40 + "quokka"), (3, "zebra")]
    items = [(1, "zebra quokka mango mango")]
    got = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.n_near for r in got} == {1: 1, 2: 0, 3: 0} == near_by_force(docs, items)


def top_by_force(rows, k=20, every=20):
    good = [(i, np.floor(np.array(x, float) * 64)) for i, x in rows if i is not None and x and all(v is not None and np.isfinite(v) for v in x)]
    out = set()
    for q, a in good:
        if q % every == 0:
            found = sorted((-int(a @ b), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return sorted(out)


def test_top_k(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(16).round(2 if i % 3 else 0).tolist()) for i in range(300)]
    rows += [(400, None), (420, [1.0, None]), (440, [float("nan")] * 16), (460, [float("inf")] * 16), (None, [1.0] * 16), (480, [1.0, 2.0]), (481, [3.0, 1.0]), (500, [0.0] * 16), (501, rows[0][1]), (502, rows[0][1])]
    made = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<double>, label int, score int")
    want = top_by_force(rows)
    for how in ({}, {"block": 16, "group": 40, "pivots": 3, "batch": 4}):
        got = sorted(map(tuple, topk.top_k(made, **how).collect()))
        assert got == want
    assert sorted(map(tuple, topk.top_k(made.union(made)).collect())) == top_by_force(rows * 2)
    assert topk.top_k(made.limit(0)).collect() == []


def test_huge_components_stay_exact(spark):
    rows = [(0, [1e14, 3.0]), (1, [-1.0, 2.0]), (2, [7.0, 1e9]), (3, [7.0, 1e9 + 1])]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    a = [int(v * 64) for v in (1e14, 3.0)]
    want = sorted(((-(sum(x * int(v * 64) for x, v in zip(a, e, strict=True))), i) for i, e in rows if i))
    got = topk.top_k(made, k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, -s) for s, i in want]


def test_threshold_stops_early():
    r = np.random.default_rng(2)
    near, far = 100 + r.integers(0, 5, (50, 4)), r.integers(-5, 5, (1000, 4))
    s = topk.Search(np.full((1, 4), 10.0), np.array([-1]), 5)
    s.over(topk.SortedLists(np.arange(50), near.astype(float)))
    before = s.scored
    s.over(topk.SortedLists(50 + np.arange(1000), far.astype(float)))
    assert s.scored == before <= 50 and set(s.top[2]) <= set(range(50))
    # one long list that falls fast: few rows are met before the threshold is below the k-th score
    falling = np.sort(r.pareto(1.5, (4000, 2)) * 100, axis=0)[::-1].round()
    t = topk.Search(np.array([[3.0, 2.0]]), np.array([-1]), 5)
    t.over(topk.SortedLists(np.arange(4000), falling))
    assert t.scored < 200 and [int(x) for x in t.top[1]] == sorted((falling @ np.array([3.0, 2.0])).astype(int), reverse=True)[:5]


def test_clusters_are_scored_in_part():
    """Of vectors in clusters a query scores little more than its own cluster's block."""
    r = np.random.default_rng(5)
    centres = r.standard_normal((32, 64)) * 64
    rows = np.floor(np.concatenate([c + r.standard_normal((200, 64)) for c in centres]))
    blocks = [topk.SortedLists(np.arange(200 * i, 200 * i + 200), rows[200 * i : 200 * i + 200]) for i in range(32)]
    queries = rows[::100][:32]
    s = topk.Search(queries, np.arange(0, 3200, 100), 20)
    for i in np.argsort(-np.stack([b.bound(queries) for b in blocks]).max(axis=1)):
        s.over(blocks[i])
    assert s.scored < 0.2 * len(queries) * len(rows)
    for q in range(len(queries)):
        scores = rows @ queries[q]
        want = sorted((-int(v), i) for i, v in enumerate(scores) if i != 100 * q)[:20]
        at = s.top[0] == q
        assert [(-int(v), int(i)) for v, i in zip(s.top[1][at], s.top[2][at], strict=True)] == want
