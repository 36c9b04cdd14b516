import random

import numpy as np
from pyspark.sql import functions as F
from tests.llm.conftest import CASES, WORDS, prose

from starprism.llm import common, decontamination, minhash


def written(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_a_passage_of_one_item_is_enough(spark, tmp_path):
    import corpus_pipeline

    one, two = prose(30, 71), prose(20, 72)
    texts = [(1, prose(50, 73) + " " + one + " " + prose(50, 74)), (2, one + " " + two), (3, prose(90, 75)), (4, None), (5, " ".join(one.split()[4:12])), (6, " ".join(one.split()[:7])), (None, two), (3, one)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(1, one), (2, two)], "item_id long, text string")
    sf = written(spark, tmp_path, benchmark=items)
    out = corpus_pipeline.drop_contaminated(spark, docs, sf)
    assert sorted(map(tuple, out.collect())) == [texts[i] for i in (2, 3, 5)] and out.columns == docs.columns
    assert [r.contaminated for r in decontamination.decontaminate(docs, items).orderBy("doc_id", "n_items").collect()] == [False, False, True, False, False, False, False, False]


def kept_by_force(rows):
    """Of each group of texts that links of a 5-word Jaccard of 0.8 reach, the row of the smallest id."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(root(i), []).append(row)
    return sorted((min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()), key=str)


def test_near_duplicates_as_by_force(spark):
    import corpus_pipeline

    r = random.Random(9)
    rows = [c for c in CASES if c[0] != 11]  # A-Z alone are lowered
    for i in range(40):
        base = [r.choice(WORDS) + str(r.randrange(50)) for _ in range(r.randrange(20, 200))]
        for j in range(4):  # copies on either side of 0.8, and chains of them
            for _ in range(r.randrange(4)):
                base[r.randrange(len(base))] = f"new{i}x{j}"
            rows.append((100 + 4 * i + j, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=str)
    assert out == kept_by_force(rows) and 60 < len(out) < 150
    dense = [(i, " ".join(f"w{j}" if j != i % 97 else f"v{i}" for j in range(97))) for i in range(400)]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(dense, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, left)) == kept_by_force(dense) and len(left) == 1


def test_candidates_come_from_simhash_too(spark, monkeypatch):
    """Finding F2: without any MinHash neighbour or shared bucket, the fingerprints' links alone find near texts."""
    import corpus_pipeline

    own, asked = minhash._print_pairs, []
    signed = minhash._signed
    monkeypatch.setattr(minhash, "_signed", lambda rows: signed(rows).withColumn("bands", F.array().cast("array<long>")))
    monkeypatch.setattr(minhash, "_print_pairs", lambda marks: asked.append(own(marks)) or asked[0])
    base = [f"w{i}" for i in range(2000)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "tail"])), (3, " ".join(base[::-1])), (4, ""), (5, None)]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(x.doc_id for x in out.collect()) == [1, 3, 4] and asked[0].count() == 1


def test_a_frequent_passage_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Finding of round 2: texts of different components that share buckets (here by a passage that is half of each)
    were all candidates, a number that grew with the square of their group."""
    import corpus_pipeline

    own, counts = minhash.materialize, []

    def counted(df, name, *more):
        out = own(df, name, *more)
        if name == "candidates":
            counts.append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    passage = [f"p{j}" for j in range(100)]
    for n in (100, 400):
        rows = [(i, " ".join([*(f"v{i}x{j}" for j in range(40)), *passage])) for i in range(n)]  # similarities of 0.52
        rows += [(1000 + i, rows[i][1] + " tail") for i in range(0, n, 10)]
        rows += [(2000 + i, " ".join(passage if j != i else f"z{i}" for j, passage in enumerate(passage))) for i in range(20, 40)]
        counts.clear()
        out = sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()), key=str)
        assert out == kept_by_force(rows) and len(out) == n + 1 and len(counts) == 2 and counts[1] <= n


def test_prefixes_of_near_sets_meet(spark):
    """Brute force: whatever the order's counts, near sets of different roots are candidates, and no pair of one root is."""
    r = np.random.default_rng(3)
    sets = []
    for n in (1, 2, 5, 9, 30, 200):
        base = r.integers(0, 1 << 63, 2 * n).astype(np.uint64) * np.uint64(2)
        for cut in range(0, n + 1, max(1, n // 12)):
            sets.append(np.unique(np.concatenate([base[cut // 2 : n], base[n : n + cut // 3], r.integers(0, 1 << 63, cut // 9).astype(np.uint64)])))
    sets = [x for x in sets if len(x)]
    rows = [(i, len(x), x.view(np.int64).tolist(), i % 5) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "rid long, n long, own array<long>, root long")
    near = {(i, j) for j in range(len(sets)) for i in range(j) if i % 5 != j % 5 and 9 * len(np.intersect1d(sets[i], sets[j])) >= 4 * (len(sets[i]) + len(sets[j]))}
    found = {(p.a, p.b) for p in minhash._apart_pairs(df.drop("root"), df.select("rid", "root")).collect()}
    assert len(near) > 20 and near <= found and all(i % 5 != j % 5 for i, j in found)


def test_histograms_rule_out_no_near_pair():
    r = np.random.default_rng(5)
    for n in (1, 4, 60, 900, 40_000, 200_000):
        both = r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        if n == 200_000:
            both >>= np.uint64(7)  # cells of over 255
        for cut in (0, n // 9, n // 5, n // 2):
            x, y = np.unique(both[: n - cut // 2]), np.unique(both[cut - cut // 2 :])
            common = len(np.intersect1d(x, y))
            cells = lambda s: np.frombuffer(minhash.histogram(s), np.uint8)[None]
            can = minhash.can_be_near(cells(x), cells(y), np.array([len(x)]), np.array([len(y)]))[0]
            assert can or 9 * common < 4 * (len(x) + len(y))
    x, y = (np.unique(r.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)) for _ in range(2))
    assert not minhash.can_be_near(cells(x), cells(y), np.array([len(x)]), np.array([len(y)]))[0]


def test_workers_drop_what_other_stages_kept():
    made = []
    make = lambda: made.append(1) or "encoder"
    user = common.releasing(lambda found: (common.kept(("test", 1), make) for _ in found), keeps=True)
    other = common.releasing(lambda found: (x for x in found))
    assert list(user([1, 2])) == list(user([1, 2])) and len(made) == 1
    assert list(other([3])) == [3] and not common._kept
    assert list(user([1])) == ["encoder"] and len(made) == 2
    common.drop_kept()
