"""The epsilon grid order join against all pairs."""

import duckdb
import numpy as np
import pytest

from millrace.llm import near_vectors as nv
from millrace.llm import registry

KINDS = "vec_id long, embedding array<float>, label int"


def plain(rows, threshold):
    """n_links, component and kept of each row, from all pairs."""
    n = len(rows)
    able = [i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, c in rows]
    links = {k: set() for k in range(n)}
    for a in range(n):
        for b in range(a):
            if able[a] and able[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for k in range(n):
        seen, todo = {k}, [k]
        while todo:
            for m in links[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        c = rows[k][0] if len(seen) == 1 else min(rows[m][0] for m in seen)
        out.append((rows[k][0], len(links[k]), c, rows[k][0] is not None and c == rows[k][0]))
    return sorted(out, key=str)


def clustered(rng, n, size=16, spread=0.04):
    """Families of vectors of several densities, copies, and vectors alone."""
    out = []
    while len(out) < n:
        centre = rng.normal(size=size)
        width = rng.choice([0, 0.001, spread, 0.1])
        out += [(centre / np.linalg.norm(centre) + width * rng.normal(size=size)).astype(np.float32).tolist() for _ in range(rng.integers(1, 40))]
    order = rng.permutation(n)
    return [(int(i) * 3, out[k], int(rng.integers(0, 3))) for i, k in enumerate(order)]


def answer(df, **options):
    return sorted((tuple(r) for r in nv.near_vectors(df, **options).collect()), key=str)


@pytest.mark.parametrize(("interval", "block", "fan"), [(4096, 128, 4), (24, 4, 1)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, interval, block, fan):
    monkeypatch.setattr(nv, "FAN_BITS", fan)
    monkeypatch.setattr(nv.join_intervals, "__defaults__", (block,))
    rows = clustered(np.random.default_rng(interval), 400 if interval > 400 else 160)
    got = answer(spark.createDataFrame(rows, KINDS), threshold=0.98, interval=interval)
    expected = plain(rows, 0.98)
    assert got == expected
    assert sum(r[1] for r in got) > 400 and sum(not r[3] for r in got) > 40


def test_dense_groups_are_settled_whole(spark, monkeypatch):
    """A tight group of most rows: nodes of the tree settle it above the intervals."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=8)
    rows = [(i, (centre + 0.001 * rng.normal(size=8)).tolist(), 1) for i in range(120)] + [(1000 + i, rng.normal(size=8).tolist(), i % 3) for i in range(30)]
    seen = []
    whole = nv.links_of_wholes
    monkeypatch.setattr(nv, "links_of_wholes", lambda i, w: seen.append(w.count()) or whole(i, w))
    monkeypatch.setattr(nv, "FAN_BITS", 1)
    assert answer(spark.createDataFrame(rows, KINDS), interval=12) == plain(rows, 0.98)
    assert seen[0] > 0


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, 0), (2, v, 0), (3, v, 1), (4, v, None), (None, v, 0), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 3.0], 0), (8, [float("nan"), 1.0, 1.0], 0)]
    rows += [(9, [float("inf"), 1.0, 1.0], 0), (10, [1.0, 2.0], 0), (11, [2.0, 4.0], 0), (12, [], 0), (13, [2.0, 4.0, 6.0], 0), (14, [1e30, 2e30, 3e30], 0), (15, [-1.0, -2.0, -3.0], 0), (-5, [1e-30, 2e-30, 3e-30], 0)]
    assert answer(spark.createDataFrame(rows, KINDS)) == plain(rows, 0.98)
    assert answer(spark.createDataFrame([], KINDS)) == []
    assert answer(spark.createDataFrame([(1, None, None)], KINDS)) == [(1, 0, 1, True)]
    more = spark.createDataFrame([(1, v, 0, 7, "x"), (2, v, 0, 8, "y")], f"{KINDS}, n_links int, component_id string")
    assert answer(more) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_vectors_at_the_threshold(spark):
    angles = [0.0, np.arccos(0.98) - 1e-6, np.arccos(0.98) + 1e-6, 2.0]
    rows = [(i, [float(np.cos(a)), float(np.sin(a))], 0) for i, a in enumerate(angles)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert [r[1] for r in answer(df)] == [1, 2, 1, 0]


def test_query_and_its_sql_agree(spark, tmp_path):
    rng = np.random.default_rng(8)
    spark.createDataFrame(clustered(rng, 200, size=64, spread=0.01), KINDS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["op12_near_vectors"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.sql(registry.ORACLE["op12_near_vectors"]).fetchall())
    assert sum(r[1] for r in got) > 100
