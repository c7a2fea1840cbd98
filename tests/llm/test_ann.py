import numpy as np
from pyspark.sql import functions as F

from facetmill.llm.ann import balanced_parts, nearest, neighbour_graph, top_of_chunk
from facetmill.llm.queries import QUERIES

ROWS = "vec_id long, embedding array<float>, label int, part int"


def brute_force(rows, k, asked):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i in sorted(good):
        if asked(i):
            out[i] = sorted(((-float((good[i] * v).sum()), j) for j, v in good.items() if j != i))[:k]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0) for i, v in rows], ROWS)


def test_recall_and_scores(spark, sf_dir):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(3000)]
    got = QUERIES["op3_learned_partitions"](spark, sf_dir(embeddings=table(spark, rows))).collect()
    want = brute_force(rows, 20, lambda i: i % 20 == 0)
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(by_query) == sorted(want) and all(sorted(v) == list(range(1, 21)) for v in by_query.values())
    hits = sum(len({j for _, j in want[q]} & {j for j, _ in v.values()}) for q, v in by_query.items())
    assert hits / (20 * len(want)) >= 0.9
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, v in list(by_query.items())[:20]:
        assert all(abs(s - vectors[q] @ vectors[j]) < 1e-9 for j, s in v.values())
        order = [(-v[r][1], v[r][0]) for r in sorted(v)]
        assert order == sorted(order)


def test_copies_nulls_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, None), (120, [0.0, 0.0]), (140, [float("nan"), 1.0]), (160, [None, 1.0]), (180, [float("inf"), 1.0]), (200, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0])]
    got = nearest(table(spark, rows), F.col("vec_id") % 20 == 0, 5).collect()
    by_query = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by_query.setdefault(r.query_id, []).append(r.vec_id)
    assert by_query == {0: [1, 2, 3, 4, 5], 20: [0, 1, 2, 3, 4], 40: [0, 1, 2, 3, 4]}


def test_fewer_candidates_and_empty_table(spark):
    few = nearest(table(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]), F.col("vec_id") % 20 == 0, 20).collect()
    assert [(r.vec_id, r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert nearest(table(spark, []), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(2)
    x = np.concatenate([c + 0.05 * rng.standard_normal((64, 8)) for c in rng.standard_normal((4, 8)) * 3])
    a, b = neighbour_graph(x, 6)
    part = balanced_parts(len(x), a, b, 4)
    assert np.bincount(part).tolist() == [64] * 4 and (part[a] == part[b]).mean() > 0.7


def test_equal_vectors_go_by_id():
    x = np.tile(np.array([[0.1, 0.7]]), (50, 1))
    got = top_of_chunk(np.arange(50)[::-1].copy(), x, np.array([3]), x[:1], 4)
    assert [j for _, j, _ in got] == [0, 1, 2, 4]


def test_chunks_of_vectors_and_queries_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(400)]
    asked = F.col("vec_id") % 5 == 0
    whole = sorted(nearest(table(spark, rows), asked, 4).collect())
    monkeypatch.setattr("facetmill.llm.ann._CHUNK", 30)
    assert sorted(nearest(table(spark, rows), asked, 4).collect()) == whole and len(whole) == 320
