import hashlib
import random

import numpy as np

from millrace.llm import suffix_dedup as S


def brute(rows, length=50):
    """By a dictionary of every string's smallest id."""
    first = {}
    key = lambda i: (i is not None, i or 0)
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s not in first or key(i) < first[s]:
                first[s] = key(i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < key(i):
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(n))


def test_against_a_dictionary_of_all_strings(docs):
    rng = random.Random(1)
    shared = [words(rng, n) for n in (8, 14, 15, 16, 20, 60, 200)]
    rows = []
    for i in range(120):
        parts = [words(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randint(30, len(p))], words(rng, rng.randint(0, 9))]
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[3][1]) for i in range(20)]
    rng.shuffle(rows)
    expected = brute(rows)
    assert sum(r[2] for r in expected) > 5000
    assert got(S.remove_repeats(docs(rows))) == expected
    assert got(S.remove_repeats(docs(rows), chunk_bytes=700, bucket_keys=300)) == expected


def test_edges(docs):
    line = "x" * 120
    rows = [(None, line), (1, line), (1, line), (2, ""), (3, None), (4, line[:49]), (5, line[:50]), (6, "y" + line[:50] + "z"), (7, "é" * 60), (8, "aé" + "é" * 40)]
    assert got(S.remove_repeats(docs(rows))) == brute(rows)
    assert got(S.remove_repeats(docs([]))) == []
    assert got(S.remove_repeats(docs([(1, "ab" * 500)]))) == brute([(1, "ab" * 500)])


def test_on_the_table(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert got(S.remove_repeats(df, chunk_bytes=40_000, bucket_keys=20_000)) == brute(rows)


def test_cut_texts_keep_their_rows_and_characters(docs):
    line = "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich, sagt man. "
    rows = [(1, line), (2, "Vorher " + line + "nachher"), (3, None), (4, ""), (4, line)]
    df = docs(rows).withColumnsRenamed({"lang": "_id"}).withColumn("chunk", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(7))
    out = S.without_repeats(df)
    assert out.columns == df.columns
    found = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect() if r["text"] is not None)
    assert found == [(1, line, len(line)), (2, "Vorher nachher", 14), (4, "", 0), (4, "", 0)]
    assert out.where("text is null").count() == 1


def test_cover_meets_every_difference():
    for d in range(S.PERIOD):
        assert any((c + d) % S.PERIOD in S.COVER for c in S.COVER)


def test_packed_keys():
    for keys in ([], [0], [1, 2, 2**64 - 1], [2**48]):
        a = np.array(keys, np.uint64)
        assert S.unpack(S.pack(a)).tolist() == keys


def test_keys_that_collide_change_nothing(docs):
    rng = random.Random(12)
    shared = [words(rng, 60) for _ in range(5)]
    rows = [(i, f"{words(rng, 20)} {rng.choice(shared)[rng.randint(0, 9) :]} {words(rng, 9)}") for i in range(40)]
    expected = brute(rows)
    assert sum(r[2] for r in expected) > 2000
    assert got(S.remove_repeats(docs(rows), chunk_bytes=900, key_bits=7, sample_bits=5)) == expected


def test_claims_that_fail_are_counted(spark, docs):
    """Hashes of few bits take different strings for equal: the check says so."""
    rng = random.Random(13)
    rows = [(i, words(rng, 60)) for i in range(30)]
    for size in (700, 1 << 20):
        chunks = S.make_chunks(docs(rows), "doc_id", "text", [], size)
        assert S.settled(chunks, S.Hashing(50, 4, 6, 50), 1000) is None
        assert S.settled(chunks, S.Hashing(50, 32, 62, 50), 1000) is not None


def test_strings_in_doubt_are_settled_by_one_more_look(spark, docs, monkeypatch):
    """Keys of few bits collide by the thousand; one look at what fails is enough."""
    rng = random.Random(14)
    shared = [words(rng, 60) for _ in range(6)]
    rows = [(i, f"{words(rng, 25)} {rng.choice(shared)[rng.randint(0, 9) :]} {words(rng, 9)}") for i in range(60)]
    rows += [(100 + i, rows[5][1]) for i in range(8)]
    expected, calls, settled = brute(rows), [], S.settled
    monkeypatch.setattr(S, "settled", lambda *a: calls.append(len(a[3])) or settled(*a))
    for size in (900, 1 << 20):
        calls.clear()
        assert got(S.remove_repeats(docs(rows), chunk_bytes=size, key_bits=10)) == expected
        assert calls == [0, 1]
    # More strings in doubt than a look takes are left to the next ones.
    calls.clear()
    monkeypatch.setattr(S, "MOST_DOUBTS", 4000)
    assert got(S.remove_repeats(docs(rows), chunk_bytes=2000, key_bits=8)) == expected
    assert 2 <= len(calls) < 12


def test_a_further_look_sorts_nothing_anew(docs, monkeypatch):
    """Samples, long ties and the rest are sorted once, however many looks there are."""
    rng = random.Random(15)
    shared = [words(rng, 60) for _ in range(6)]
    rows = [(i, f"{words(rng, 25)} {rng.choice(shared)[rng.randint(0, 9) :]} {words(rng, 9)}") for i in range(50)]
    names, stored = [], S.stored
    monkeypatch.setattr(S, "stored", lambda df, name, *a: names.append(name) or stored(df, name, *a))
    assert got(S.remove_repeats(docs(rows), chunk_bytes=900, key_bits=10)) == brute(rows)
    assert names.count("shared-look_keys") >= 1
    assert [names.count(f"shared-{x}_keys") for x in ("sample", "long", "rest")] == [1, 1, S.REST_PARTS]


def test_claims_on_one_chunk_are_dealt(spark, docs, monkeypatch):
    """All documents copy from the first one; its claims don't meet in a task."""
    rng = random.Random(16)
    passage = words(rng, 150)
    rows = [(i, f"{words(rng, 9)} {passage} {words(rng, 9)}") for i in range(60)]
    frames, dealt = [], S.dealt
    monkeypatch.setattr(S, "CLAIM_BYTES", 3000)
    monkeypatch.setattr(S, "dealt", lambda *a: frames.append(dealt(*a)) or frames[-1])
    assert got(S.remove_repeats(docs(rows), chunk_bytes=600)) == brute(rows)
    # Tables this small would be broadcast, or their partitions put together.
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        lists = frames[0].selectExpr("chunk", "size(claims) AS n", "spark_partition_id() AS p").collect()
    finally:
        for key in settings:
            spark.conf.unset(key)
    first = min(r["chunk"] for r in lists)
    assert sum(r["n"] for r in lists if r["chunk"] == first) > 20
    assert len({r["p"] for r in lists if r["chunk"] == first}) > 1


def test_steps_against_plain_ones():
    rng = np.random.default_rng(17)
    of = np.unique(rng.integers(0, 1 << 62, 5000, np.uint64))
    keys = np.concatenate([rng.choice(of, 3000), rng.integers(0, 1 << 62, 3000, np.uint64)])
    there = {k: i for i, k in enumerate(of.tolist())}
    for some in (keys, keys[::20]):
        assert S.find(some, of).tolist() == [there.get(k, -1) for k in some.tolist()]
    assert S.find(keys, of[:0]).tolist() == [-1] * len(keys)
    x, y = rng.integers(0, 2, 3000).astype(np.uint8), rng.integers(0, 2, 3000).astype(np.uint8)
    y[500:900] = x[700:1100]
    y[620] ^= 1
    a = np.concatenate([np.arange(700, 1060, 3), rng.integers(0, 2900, 200)])
    b = np.concatenate([np.arange(500, 860, 3), rng.integers(0, 2900, 200)])
    plain = [bytes(x[i : i + 50]) != bytes(y[j : j + 50]) for i, j in zip(a, b, strict=True)]
    assert 10 < sum(plain[:120]) < 100
    assert S.differ(x, a, y, b, 50).tolist() == plain
    # Keys of over 60 bits and owners don't fit into one number.
    for top in (1 << 10, 1 << 62):
        each = [np.unique(rng.integers(0, top, 90, np.uint64)) for _ in range(9)]
        each[5] = np.unique(np.concatenate([each[5], each[2][:40], each[7][-40:]]))
        owners = {}
        for o, ks in enumerate(each):
            for k in ks.tolist():
                owners.setdefault(k, []).append(o)
        for every in (False, True):
            found = S.shared_keys(np.concatenate(each), [len(ks) for ks in each], every)
            expected = [(k, o, owners[k][0]) for o, ks in enumerate(each) for k in ks.tolist() if len(owners[k]) > 1 and (every or o > owners[k][0])]
            assert list(zip(*(z.tolist() for z in found), strict=True)) == expected
