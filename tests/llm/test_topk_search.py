import numpy as np
import pytest

from condensa.llm.topk_search import topk_search

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def brute(rows, k, every):
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v, *_ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = set()
    for q, x in good:
        if q % every == 0:
            s = sorted(((-int(x @ y), p) for p, y in good if p != q))[:k]
            out |= {(q, r + 1, p, -d) for r, (d, p) in enumerate(s)}
    return out


def rows_of(df):
    return {tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()}


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_equals_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    rows = []
    centres = rng.normal(size=(6, 8))
    for i in range(900):
        v = centres[i % 6] + spread * rng.normal(size=8)
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([0.2, 1.0, 3.0])], "x", None))
    # Ties: many copies of one vector.
    rows += [(i, rows[7][1], None, "y") for i in range(900, 1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk_search(df, df.filter("vec_id % 50 = 0"), bucket_rows=64, query_block=7, coordinate_from=0.3)
    assert rows_of(got) == brute(rows, 5, 50)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, -2.0], "", ""), (50, None, "", ""), (100, [nan, 1.0], "", ""), (1, [inf, 0.0], "", ""), (2, [None, 1.0], "", ""), (None, [1.0, 1.0], "", ""), (3, [0.0, 0.0], None, None), (150, [0.0, 0.0], "", ""), (4, [-1.0, -1.0], "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(topk_search(df, df.filter("vec_id % 50 = 0"))) == brute(rows, 5, 50)


def test_products_beyond_64_bits(spark):
    # Components whose products wrap in 64 bits; in the last rows even one product is beyond them.
    rows = [(i, [float(np.float32(3e7 + 1000 * i)), float(i)], "", "") for i in range(0, 200, 5)]
    got = rows_of(topk_search(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows, SCHEMA).filter("vec_id % 50 = 0"), bucket_rows=8, query_block=2))
    end = 2**63 - 1
    assert got == {(q, r, p, s) for q, r, p, s in got} and len(got) == 20
    exact = {(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v, *_ in rows}
    exact = dict(exact)
    for q in range(0, 200, 50):
        want = sorted(((-min(end, sum(a * b for a, b in zip(exact[q], exact[p]))), p) for p in exact if p != q))[:5]
        assert [(p, s) for _, _, p, s in sorted(x for x in got if x[0] == q)] == [(p, -s) for s, p in want]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topk_search(df, df).collect() == []
