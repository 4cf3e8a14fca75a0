"""Hard negatives against all pairs."""
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows, anchor, label, positives=5, negatives=10, low=30, high=90):
    data = []
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is not None and r["label"] is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            data.append((r["vec_id"], label(r["vec_id"], r["label"]), [math.floor(256 * float(np.float32(x))) for x in v]))
    out = Counter()
    for k, (a, la, va) in enumerate(data):
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, lab) for j, (i, lab, v) in enumerate(data) if j != k)
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            window = [x for x in scored if x[2] != la and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            for rank, (t, i, _) in enumerate(window, 1):
                out[a, p, rank, i, -s, -t] += 1
    return out


def shifted(i, label):
    return (label + 1) % 10 if i % 7 == 0 else label


def test_query_against_all_pairs(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = queries.op13_hard_negatives(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    assert Counter(map(tuple, got.collect())) == slow(rows, lambda i: i % 100 == 0, shifted)
    assert dict(got.dtypes)["rank"] == "int"


@pytest.fixture(scope="module")
def odd(spark):
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.normal(size=6 if k % 9 else 4)], int(r.integers(3))) for k in range(300)]
    rows += [(k, rows[k][1], rows[k][2]) for k in range(0, 60, 2)]  # repeated rows
    rows += [(400 + k, [1.0, 0.0, 0.0], k % 2) for k in range(40)]  # ties
    rows += [(None, [1.0], 1), (500, None, 1), (501, [1.0, None], 1), (502, [float("nan")], 1), (503, [float("inf"), 1.0], 0), (504, [1.0, 1.0], None),
             (505, [], 1), (510, [0.0, 0.0], 0), (520, [-1.0] * 6, 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("chunk", [1 << 24, 30_000])
def test_odd_rows_in_chunks(odd, chunk):
    got = hard_negatives.mine(odd, F.col("vec_id") % 10 == 0, chunk_bytes=chunk).collect()
    want = slow(odd.collect(), lambda i: i % 10 == 0, lambda i, lab: lab)
    assert Counter(map(tuple, got)) == want and want


def test_other_parameters_and_clashing_columns(odd):
    extra = odd.withColumns({c: F.lit("x") for c in ("id", "row", "anchor", "vector", "size", "rank", "score", "place")})
    got = hard_negatives.mine(extra, F.col("vec_id") % 10 == 0, positives=2, negatives=3, low=10, high=50).collect()
    assert Counter(map(tuple, got)) == slow(odd.collect(), lambda i: i % 10 == 0, lambda i, lab: lab, 2, 3, 10, 50)


def test_scan_leaves_only_wanted_candidates():
    """Exact scores of what is left, and no candidate in the window is lost, for any order of dimensions."""
    r = np.random.default_rng(7)
    columns = np.floor(r.normal(size=(40, 500)) * 50)
    for _ in range(20):
        anchor = np.floor(r.normal(size=40) * 50)
        true = anchor @ columns
        low, high = np.quantile(true, [0.9, 0.95])
        at, score = hard_negatives.vertical(columns, columns.min(axis=1), columns.max(axis=1), anchor, np.arange(500) % 3 > 0,
                                            lambda a, b: (b >= low) & (a <= high))
        assert sorted(at) == [k for k in range(500) if k % 3 > 0 and low <= true[k] <= high]
        assert (score == true[at]).all()


def test_none_and_too_large(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(empty, F.lit(True)).count() == 0
    big = spark.createDataFrame([(1, [3e30], 1), (2, [1.0], 1)], SCHEMA)
    with pytest.raises(Exception, match="too large"):
        hard_negatives.mine(big, F.lit(True)).count()
