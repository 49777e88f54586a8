"""Hard negatives against all pairs of anchors and rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import hard_negatives as hn
from millrace.llm import registry

KINDS = "vec_id long, embedding array<float>, label int"


def plain(rows, positives=5, negatives=10):
    """The contract on (id, vector, label), scored pair by pair with whole numbers."""
    whole = lambda v: [int(np.floor(256 * float(np.float32(x)))) for x in v]
    able = [(i, whole(v), c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, v, c in sorted(able, key=lambda r: (r[0], r[2], r[1])):
        if i % 100 == 0:
            anchors.setdefault(i, (v, c))
    out = []
    for a, (q, label) in anchors.items():
        scored = sorted({(-sum(x * y for x, y in zip(q, v, strict=False)), i, c == label) for i, v, c in able if i != a})
        for s, i, _ in [r for r in scored if r[2]][:positives]:
            fit = [(n, j) for n, j, same in scored if not same and 30 * -s <= 100 * -n <= 90 * -s][:negatives]
            out += [(a, i, k + 1, j, -s, -n) for k, (n, j) in enumerate(fit)]
    return sorted(out)


def answer(df, **options):
    return sorted(tuple(r) for r in hn.mine_hard_negatives(df, F.col("vec_id") % 100 == 0, **options).collect())


@pytest.fixture
def tight(monkeypatch):
    """Many groups, blocks and lots on few rows."""
    for name, value in {"GROUP": 64, "BLOCK": 16, "LOT": 8, "PIVOTS": 6}.items():
        monkeypatch.setattr(hn, name, value)


def vectors(rng, n, size=8):
    centres = rng.normal(size=(12, size))
    out = centres[rng.integers(0, 12, n)] + rng.choice([0, 0.05, 0.5], (n, 1)) * rng.normal(size=(n, size))
    return [(int(i), v.astype(np.float32).tolist(), int(rng.integers(0, 4))) for i, v in zip(rng.permutation(n) * 5, out, strict=True)]


def test_all_negatives_are_found(spark, tight):
    rows = vectors(np.random.default_rng(1), 500)
    got = answer(spark.createDataFrame(rows, KINDS))
    assert got == plain(rows) and len(got) > 500


def test_brackets_hold_and_rule_out():
    """Every score lies within its row's bracket, and on clustered rows few are scored."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * (rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + 0.02 * rng.normal(size=(4000, 16))))
    pivots = hn.choose_pivots(x[:1000], 32)
    space = hn.Space(pivots, (pivots**2).sum(1), (x * x).sum(1).max())
    q = x[:50]
    d, e, scores = space.of_rows(x), space.of_anchors(q), q @ x.T
    base = ((q * q).sum(1) + space.most)[:, None]
    near, far = np.abs(d[None] - e[:, None]).max(2), (d[None] + e[:, None]).min(2)
    assert (scores <= (base - near**2) / 2 + space.slack(q)[:, None]).all()
    assert (scores >= (base - far**2) / 2 - space.slack(q)[:, None]).all()
    labels, seen = np.zeros(4000, np.int64), {}
    order = np.lexsort((d.min(1), d.argmin(1)))
    rows = hn.Table(np.arange(4000)[order], labels, x[order], d[order])
    anchors = hn.Table(np.arange(50), labels[:50], q, e)
    wishes = np.array([[k, 0, 0, -(2**62), 2**62] for k in range(50)])
    best = hn.search(rows, anchors, wishes, space, 5, True, seen)
    for k in range(50):
        expected = sorted((-int(s), i) for i, s in enumerate(scores[k]) if i != k)[:5]
        assert [(-s, i) for s, i in zip(best[k].scores.tolist(), best[k].ids.tolist(), strict=True)] == expected
    assert seen["scored"] < 0.4 * seen["pairs"]


def test_odd_rows(spark, tight):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v, 1), (0, v, 1), (1, v, 1), (1, v, 1), (2, v, 1), (3, [0.5, 1.0, 1.5], 2), (3, [0.5, 1.0, 1.5], 2), (4, [0.5, 1.0, 1.5], 3), (5, None, 1), (6, [1.0, None, 1.0], 1)]
    rows += [(7, [float("nan"), 1.0, 1.0], 1), (8, [float("inf"), 1.0, 1.0], 2), (None, v, 1), (9, v, None), (100, [1.0, 1.0], 2), (10, [0.0, 0.0, 0.0], 2), (11, [], 2), (200, [0.0, 0.0, 0.0], 5), (12, [-1.0, -2.0, -3.0], 1), (300, [-1.0, 0.0, 0.0], 1), (300, [1.0, 0.0, 0.0], 2)]
    assert answer(spark.createDataFrame(rows, KINDS)) == plain(rows)
    assert answer(spark.createDataFrame([], KINDS)) == []
    assert answer(spark.createDataFrame([(100, v, 1)], KINDS)) == []
    more = spark.createDataFrame([(*r, 5, "x") for r in rows], f"{KINDS}, rank int, wishes string")
    assert answer(more) == plain(rows)


def test_large_components_are_scored_exactly(spark, tight):
    big = 2.0**20
    rows = [(0, [big, 1.0], 0), (1, [big, 3.0], 0), (2, [big, 2.0], 0), (3, [big * 0.5, 1.0], 1), (4, [big * 0.5, 2.0], 1)]
    assert answer(spark.createDataFrame(rows, KINDS)) == plain(rows)
    with pytest.raises(Exception, match="64 bits"):
        answer(spark.createDataFrame([(0, [1e20], 0), (1, [1e20], 0)], KINDS))


def test_query_and_its_sql_agree(spark, tmp_path):
    spark.createDataFrame(vectors(np.random.default_rng(4), 600, 64), KINDS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["op11_hard_negatives"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql(registry.ORACLE["op11_hard_negatives"]).fetchall()) and got
