import numpy as np

from wattframe.llm.neighbours import learn_router, nearest_neighbours, partition_graph, _nearest

SCHEMA = "vec_id long, embedding array<float>, label int, row long, part string"


def brute(ids, x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(6)
    x = (rng.standard_normal((40, 16))[rng.integers(0, 40, 6000)] + 0.4 * rng.standard_normal((6000, 16))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), 0, 1, "p") for i, v in enumerate(x)], SCHEMA)
    got = {}
    for r in nearest_neighbours(table).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, 6000, 100):
        wanted = brute(np.arange(6000), x.astype(float), q, 10)
        hits += len({i for i, _ in wanted} & {i for i, _ in got[q].values()})
        assert sorted(got[q]) == list(range(1, 11)) and sorted(s for _, s in got[q].values()) == [got[q][k][1] for k in range(1, 11)]
        for i, s in got[q].values():
            assert abs(s - np.sqrt(((x[i].astype(float) - x[q].astype(float)) ** 2).sum())) < 1e-12
    assert set(got) == set(range(0, 6000, 100)) and hits / 600 >= 0.9


def test_hard_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 0.0]), (8, [0.0, 1.0]),
            (8, [0.0, 1.0]), (100, [3.0, 0.0]), (200, [None, 1.0])]
    table = spark.createDataFrame([(i, v, None, None, None) for i, v in rows], SCHEMA)
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in nearest_neighbours(table).orderBy("query_id", "rank").collect()]
    half = round(2**0.5, 6)
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 8, half), (0, 4, 8, half), (0, 5, 100, 2.0), (100, 1, 0, 2.0), (100, 2, 0, 2.0), (100, 3, 1, 2.0), (100, 4, 2, 2.0),
                   (100, 5, 8, round(10**0.5, 6)), (100, 6, 8, round(10**0.5, 6))]
    assert nearest_neighbours(table.limit(0)).count() == 0


def test_parts_are_balanced_and_follow_clusters():
    rng = np.random.default_rng(7)
    x = np.repeat(4 * rng.standard_normal((8, 12)), 100, 0) + 0.2 * rng.standard_normal((800, 12))
    part = partition_graph(_nearest(x, np.arange(800), 10), 8)
    assert set(np.bincount(part)) == {100}
    router = learn_router(x, 8)
    assert router.parts == 8 and router.probes <= 4
