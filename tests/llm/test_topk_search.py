import math
import random

import numpy as np
import pytest

from trafficbrick.llm import topk_search as K

SCHEMA = "score string, vec_id long, embedding array<float>"


def brute(rows, queries, k):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * float(np.float32(x))) for x in v]

    vecs = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    out = []
    for q, v in queries:
        w = whole(v)
        if w is None:
            continue
        limit = (1 << 63) - 1
        best = sorted((-max(-limit - 1, min(limit, sum(a * b for a, b in zip(w, x)))), i) for i, x in vecs if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block,chunk", [(8192, 8 << 20), (16, 1024)])
def test_matches_brute_force(spark, table, monkeypatch, block, chunk):
    monkeypatch.setattr(K, "CHUNK_BYTES", chunk)
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([rnd.gauss(0, 1), 0.0, 0.5, 3.0]) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(30)] + [(300, None), (301, [1.0, None]), (302, [float("nan")] * 6),
             (303, [float("inf")] * 6), (304, []), (305, [2.0]), (306, [0.1] * 9)]
    queries = [r for r in rows if r[0] % 5 == 0]
    df = table([("s", i, v) for i, v in rows], SCHEMA)
    got = K.top_k(df, df.where("vec_id % 5 = 0"), k=7).collect()
    assert sorted(map(tuple, got)) == brute(rows, queries, 7)


def test_huge_values_few_rows_and_empty_tables(spark, table):
    rows = [(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [1e30, 3.0])]
    df = table([("s", i, v) for i, v in rows], SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id) for r in K.top_k(df, df).collect())
    assert got == [(q, r, i) for q, r, i, _ in brute(rows, rows, 10)]
    none = spark.createDataFrame([], SCHEMA)
    assert K.top_k(none, none).count() == 0 and K.top_k(df, none).count() == 0 and K.top_k(none, df).count() == 0


def test_index_members_hold_the_best():
    rnd = np.random.default_rng(2)
    early = 0
    for shape in ((500, 8), (300, 1), (5, 4)):
        x = (rnd.normal(size=shape) ** 3 * 500).astype(np.int64)
        index = K.ImpactIndex(x)
        for _ in range(20):
            q = (rnd.normal(size=shape[1]) ** 3 * 500).astype(np.int64)
            best = set(np.argsort(-(x @ q), kind="stable")[:10].tolist())
            kth = np.sort(x @ q)[::-1][:10][-1]
            got = set(index.members(q, 10, None).tolist())
            assert {r for r in best if (x @ q)[r] > kth} <= got and sum((x @ q)[list(got)] >= kth) >= min(10, len(x))
            early += len(got) < len(x) / 2
    assert early > 10


def test_query_on_the_table(spark, sf_small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()]
    got = sorted(map(tuple, K.op5_topk_search(spark, sf_small).collect()))
    assert got == brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
