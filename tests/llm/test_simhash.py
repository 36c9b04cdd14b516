import random
import re

import numpy as np
import xxhash
from tests.llm.conftest import CASES, prose

from starprism.llm import components, simhash


def fingerprint(text, words=4):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(found[i : i + words]), 42) for i in range(max(1, len(found) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def by_force(prints, distance):
    """Label per place: the least id that links reach."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_groups(spark, docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    prints = [fingerprint(t) for _, t in CASES]
    roots = by_force(prints, 4)
    want = []
    for i, (doc, _) in enumerate(CASES):
        own = [CASES[j][0] for j in range(len(CASES)) if roots[j] == roots[i] and CASES[j][0] is not None]
        want.append((doc, f"{prints[i]:016x}", min(own, default=None)))
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(empty).collect() == []


def test_balls_find_every_near_pair():
    r = random.Random(2)
    for pieces in (1, 2, 3, 4, 5):
        cut = simhash.segments(4, pieces)
        for _ in range(300):
            x = r.getrandbits(64)
            y = x
            for b in r.sample(range(64), r.randrange(5)):
                y ^= 1 << b
            assert any((((x ^ y) >> a) & ((1 << n) - 1)).bit_count() <= radius for a, n, radius in cut)
    assert len(simhash.ball(10, 2)) == 1 + 10 + 45


def test_dense_groups_and_crowded_keys(spark):
    r = random.Random(4)
    centers = [r.getrandbits(64) for _ in range(12)]
    prints = set()
    for c in centers:
        for _ in range(60):
            y = c
            for b in r.sample(range(64), r.randrange(4)):
                y ^= 1 << b
            prints.add(y)
    prints = sorted(prints)
    roots = by_force(prints, 4)
    marks = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, rep long")
    for crowd, pieces in ((1000, None), (5, None), (1000, 2)):
        got = {x.fp % (1 << 64): x.label for x in simhash.near_links(marks, 4, pieces, crowd).collect()}
        assert [got[p] for p in prints] == roots


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 60), (60, 61), (7, 7), (200, 100)]
    nodes = spark.createDataFrame([(i,) for i in [*range(52), 60, 61, 100, 200]], "node long")
    got = dict(components.connected(nodes, spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(51)} == {0} and got[51] == 51 and {got[i] for i in (60, 61, 100, 200)} == {60}


def test_simhash_counts_agree():
    h = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2)
    for n in (1, 2, 199, 200, 500):
        bits = [2 * sum(int(x) >> b & 1 for x in h[:n]) > n for b in range(64)]
        assert simhash.simhash(h[:n]) == sum(1 << b for b in range(64) if bits[b])
    assert fingerprint(prose(300, 9)) == fingerprint(prose(300, 9).upper())


def test_nothing_that_grows_is_broadcast(spark):
    """Finding F1: by estimates that leave out exploded rows the driver gathered probes and salted copies."""
    prints = sorted({random.Random(6).getrandbits(62) ^ 1 << b for b in range(40)} | {(i * 0x9E3779B97F4A7C15) >> 2 & (1 << 62) - 1 for i in range(200)})
    marks = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, rep long")
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    got = {x.fp: x.label for x in simhash.near_links(marks).collect()}
    bus.waitUntilEmpty(30_000)
    assert [got[p] for p in prints] == by_force(prints, 4)
    after = store.executionsList(int(before), int(store.executionsCount() - before))
    plans = [after.apply(i).physicalPlanDescription() for i in range(after.size())]
    assert len(plans) > 5 and any("SortMergeJoin" in p for p in plans) and not [p for p in plans if "BroadcastExchange" in p]


def test_near_pairs_join_what_links_reach(spark):
    r = random.Random(8)
    prints = {r.getrandbits(64) for _ in range(20)}
    for c in sorted(prints):
        prints |= {c ^ 1 << r.randrange(64) ^ 1 << r.randrange(64) for _ in range(6)}
    prints = sorted(prints)
    roots = by_force(prints, 4)
    marks = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, rep long")
    pairs = [(x.a % (1 << 64), x.b % (1 << 64)) for x in simhash.near_pairs(marks).collect()]
    assert pairs and all((a ^ b).bit_count() <= 4 for a, b in pairs)
    label = {p: p for p in prints}
    for _ in prints:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    at = {p: i for i, p in enumerate(prints)}
    assert [at[label[p]] for p in prints] == roots
