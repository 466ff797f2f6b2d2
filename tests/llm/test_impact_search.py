"""Exact search against all inner products: many blocks, ties, signs, hot vectors, hostile values."""

import numpy as np
import pyarrow as pa
import pytest

from wattfleet.llm import impact_search as S

SCHEMA = "vec_id long, vector array<double>"


def best(rows, queries, k):
    usable = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in queries:
        if a is None or not all(x is not None and np.isfinite(x) for x in a):
            continue
        scored = sorted(
            (-sum(int(x) * int(y) for x, y in zip(a, v)), i is None, i or 0) for i, v in usable if (i is None) != (q is None) or i != q
        )[:k]
        out += [(q, rank + 1, None if null else i, -s) for rank, (s, null, i) in enumerate(scored)]
    return sorted(out, key=str)


def found(spark, rows, queries, k, parts=3):
    table = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    index = S.build_index(table, "vec_id", "vector")
    got = S.search(index, spark.createDataFrame(queries, SCHEMA).repartition(2), k, "vec_id", "vector").collect()
    return index, sorted([(r.query_id, r["rank"], r.id, r.score) for r in got], key=str)


def vectors(rng, n, dims, scale):
    groups = rng.normal(0, scale, (6, dims))
    return [(i, np.floor(groups[i % 6] + rng.normal(0, scale / 2, dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("dims,scale,k", [(16, 30, 5), (64, 30, 1), (3, 2, 7), (1, 1, 4), (8, 3000, 5)])
def test_equals_all_products(spark, monkeypatch, dims, scale, k):
    monkeypatch.setattr(S, "BLOCK_COMPONENTS", 60 * dims)  # many small blocks
    monkeypatch.setattr(S, "CHUNK_COMPONENTS", 7 * dims)
    rows = vectors(np.random.default_rng(dims), 500, dims, scale)
    queries = [r for r in rows if r[0] % 20 == 0]
    index, got = found(spark, rows, queries, k)
    assert index.count() >= 8 and got == best(rows, queries, k)


def test_proof_leaves_vectors_out():
    rng = np.random.default_rng(4)
    matrix = np.floor(rng.normal(0, 20, (4000, 32)))
    matrix[:40] = matrix[0] + np.floor(rng.normal(0, 2, (40, 32)))
    batch = S._index_block(0, pa.array(range(4000)), matrix)
    row = {c: batch.column(c)[0] for c in batch.schema.names}
    block = S.Block({c: v.values if c == "ids" else v.as_buffer() if pa.types.is_binary(v.type) else v.as_py() for c, v in row.items()})
    possible = block._possible(matrix[:1], [np.arange(4000) != 0], 5)[0]
    assert 5 <= len(possible) < 400
    others = 1 + np.argsort(-(matrix[1:] @ matrix[0]))
    assert set(others[:5].tolist()) <= set(possible.tolist())


def test_equal_vectors_tie_by_id(spark):
    rows = [(i, [3.0, -4.0, 0.0]) for i in range(400)] + [(400 + i, [1.0, float(-i % 3), 2.0]) for i in range(100)]
    queries = [rows[0], rows[3], rows[450]]
    assert found(spark, rows, queries, 5)[1] == best(rows, queries, 5)


def test_nulls_lengths_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan]), (5, [inf, 1.0]), (6, []), (7, [2.0, 2.0, 9.0]), (None, [1.0, 1.0]), (8, [0.0]),
            (7, [2.0, 2.0, 9.0]), (9, [-1.0, -1.0]), (1, [5.0, 5.0])]
    queries = [(1, [1.0, 2.0]), (6, []), (7, [2.0, 2.0, 9.0]), (None, [1.0, 1.0]), (2, None), (5, [inf, 1.0]), (50, [1.0, 0.0, 0.0, 7.0])]
    assert found(spark, rows, queries, 20)[1] == best(rows, queries, 20)


def test_large_values_are_exact_and_scores_stay_in_a_long(spark):
    rows = [(1, [2.0**40, 1.0]), (2, [2.0**40, 2.0]), (3, [2.0**50, -1.0]), (4, [-(2.0**62), 0.0]), *[(10 + i, [float(i), 2.0**33]) for i in range(30)]]
    queries = [(1, [2.0**20, 1.0]), (9, [2.0**62, 1.0])]
    limit = lambda s: max(min(s, 2**63 - 1), -(2**63))
    want = sorted([(q, r, i, limit(s)) for q, r, i, s in best(rows, queries[:1], 6)], key=str)
    got = found(spark, rows, queries, 6)[1]
    assert [g for g in got if g[0] == 1] == want and max(g[3] for g in got if g[0] == 9) == 2**63 - 1


def test_empty_tables_and_other_columns(spark):
    table = spark.createDataFrame([(1, [1.0], 5, "x"), (2, [2.0], 6, "y")], "vec_id long, vector array<double>, block int, id string")
    index = S.build_index(table, "vec_id", "vector")
    assert S.search(index, table, 5, "vec_id", "vector").count() == 2
    assert S.search(index, table.limit(0), 5, "vec_id", "vector").count() == 0
    none = S.build_index(table.limit(0), "vec_id", "vector")
    assert S.search(none, table, 5, "vec_id", "vector").count() == 0


def test_query_equals_sql(spark, sf_dir):
    from compare import connect, run

    from wattfleet.llm.queries import ORACLES, QUERIES

    rows, _, problem = run(spark, sf_dir, "op13_top_k", QUERIES["op13_top_k"], ORACLES["op13_top_k"], connect(sf_dir))
    assert problem is None and rows > 0
