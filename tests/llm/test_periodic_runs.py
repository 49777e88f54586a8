"""Runs against a plain search over all periods, and the query against its contract."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import periodic_runs as pr
from millrace.llm import registry


def plain_runs(codes, least_length, least_exponent):
    """Maximal stretches that agree with themselves q further on, for each q; those that a smaller
    period explains are left out."""
    found = set()
    for q in range(1, len(codes)):
        i = 0
        while i + q < len(codes):
            start = i
            while i + q < len(codes) and codes[i] == codes[i + q]:
                i += 1
            if i - start >= q:
                found.add((start, i - start + q, q))
            i += 1
    smallest = lambda s, n: next(p for p in range(1, n + 1) if codes[s : s + n - p] == codes[s + p : s + n])
    return sorted((s, n, q) for s, n, q in found if n >= max(least_length, least_exponent * q) and smallest(s, n) == q)


def repetitive(rng):
    k, n, out = rng.randint(1, 4), rng.randint(0, 70), []
    while len(out) < n:
        unit = [rng.randrange(k) for _ in range(rng.randint(1, 7))]
        out += unit * rng.randint(1, 8) if rng.random() < 0.7 or not out else out[-rng.randint(1, 20) :]
    return out


def test_lyndon_array_gives_next_smaller_suffixes():
    rng = random.Random(1)
    for _ in range(400):
        c = repetitive(rng)
        after, shared = pr.lyndon_array(c)
        for i in range(len(c)):
            j = next((j for j in range(i + 1, len(c)) if c[j:] < c[i:]), len(c))
            assert after[i] == j
            assert shared[i] == next((k for k in range(len(c) - j) if c[i + k] != c[j + k]), len(c) - j)


@pytest.mark.parametrize(("length", "exponent"), [(2, 2), (5, 3), (6, 4)])
def test_runs_are_those_of_a_plain_search(length, exponent):
    rng = random.Random(length)
    for _ in range(500):
        c = repetitive(rng)
        expected = plain_runs(c, length, exponent)
        assert pr.all_runs(c, length, exponent) == expected
        assert pr.find_runs(np.array(c, np.int64), length, exponent) == expected


def test_work_grows_in_proportion():
    """Comparisons of codes on words that make naive extensions quadratic."""

    class Code(int):
        seen = 0

        def __eq__(self, other):
            Code.seen += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    a, b = [0], [0, 1]
    while len(b) < 4000:
        a, b = b, b + a
    for c in ([0] * 4000, [0, 1] * 2000 + [2], [0, 1, 2] * 1300, b[:4000], ([0, 0, 1] * 30 + [2]) * 44):
        Code.seen = 0
        pr.lyndon_array([Code(x) for x in c])
        assert Code.seen < 2.1 * len(c)


def expected_row(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 6, 4)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest(lines), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


ODD = [(None, None), (None, "a a a a a a a"), (1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "a " * 6), (5, "a " * 6), (6, "a\x0bb\x0c" * 40), (7, "é ü é ü é ü é ü é ü"), (8, "x y " * 9), (9, "a b " * 3)]


def test_query_holds_its_contract(docs, tmp_path, spark):
    rng = random.Random(9)
    rows = ODD + [(100 + i, " ".join(rng.choice("abcd") * rng.choice([1, 1, 2]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["op13_runs"](spark, str(tmp_path)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got), key=key) == sorted((expected_row(*r) for r in rows), key=key)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t in rows)


def test_runs_of_the_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in registry.QUERIES["op13_runs"](spark, small).collect()}
    some = [r for r in docs if len(r["text"]) < 1500]
    assert len(got) == len(docs) and len(some) > 20
    for r in some:
        assert got[r["doc_id"]] == expected_row(r["doc_id"], r["text"])


def test_odd_tables(spark, docs):
    assert pr.periodic_runs(docs([])).count() == 0
    assert pr.run_digests(pr.periodic_runs(pr.with_planted_periods(docs([])))).count() == 0
    df = spark.createDataFrame([(1, "a b " * 4, "x", 3, 4.0)], "doc_id long, text string, runs string, w int, best double")
    row = pr.run_digests(pr.periodic_runs(pr.with_planted_periods(df))).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (1, 0, 8, 2, 4000)
    runs = pr.periodic_runs(df).select("collapsed", F.col("runs")[0]["period"].alias("q")).first()
    assert tuple(runs) == ("a b", 2)


def test_a_long_text(docs):
    text = "one two three " * 60_000 + " ".join(f"w{i % 977}" for i in range(150_000))
    row = pr.periodic_runs(docs([(1, text)])).first()
    assert [tuple(r) for r in row["runs"]] == [(0, 180_000, 3), (180_000, 150_000, 977)]
    assert len(row["collapsed"].split()) == 3 + 977
