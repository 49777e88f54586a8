import random

import numpy as np

import xxhash

from millrace.llm import simhash as S


def fingerprint(text, k):
    w = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, k=4, radius=4):
    fps = [(i, fingerprint(t, k)) for i, t in rows]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(fps):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return sorted(((i, f"{f:016x}", least.get(find(n))) for n, (i, f) in enumerate(fps)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=str)


def test_against_all_pairs(docs):
    rng = random.Random(2)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 5) + str(rng.randint(0, 99)) for _ in range(rng.randint(20, 300))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = "EDIT" + str(rng.random())
        rows.append((i, " \t".join(w)))
    rows += [(None, rows[0][1]), (500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "One  TWO"), (3, rows[9][1]), (3, rows[9][1])]
    expected = components(rows)
    assert len({c for *_, c in expected}) > 8
    assert got(S.near_duplicates(docs(rows))) == expected


def test_empty(docs):
    assert got(S.near_duplicates(docs([]))) == []


def test_every_close_pair_meets_under_a_mask():
    rng = random.Random(3)
    for radius in (1, 2, 4):
        masks = S.covering_masks(radius)
        for _ in range(2000):
            flipped = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & flipped == 0 for m in masks)


def test_lists_that_part_a_bucket(spark):
    """Chains of fingerprints that stay one component however the buckets are dealt."""
    rng = random.Random(4)
    nodes, fps = [], set()
    for _ in range(6):
        f = rng.getrandbits(63)
        for _ in range(60):
            f ^= 1 << rng.randrange(63)
            fps.add(f)
    nodes = sorted(fps)
    expected = {}
    parent = {f: f for f in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    expected = {f: find(f) for f in nodes if find(f) != f}
    df = spark.createDataFrame([(f,) for f in nodes], "fp long")
    for size in (4096, 8, 3):
        assert {r["node"]: r["component"] for r in S.linked(df, 2, size).collect()} == expected


def test_one_of_each_group_stays(docs):
    rng = random.Random(6)
    text = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}" for _ in range(n)]
    rows, groups = [], []
    for g in range(40):
        w, own = text(rng.choice([60, 150, 400])), []
        for k in range(3):
            c = list(w)
            for at in range(20, len(c), 60):  # some changed words: similarities of 0.8 and more
                if k:
                    c[at] = f"new{rng.random()}"
            own.append(100 * g + k)
            rows.append((own[-1], " ".join(c)))
        groups.append(own)
    lone = [(9000 + i, " ".join(text(120))) for i in range(60)]
    odd = [(None, None), (8001, ""), (8002, " \n"), (8003, "one two"), (8003, "one two"), (None, "only null here")]
    rows += lone + odd
    rng.shuffle(rows)
    df = docs(rows)
    out = S.keep_one_of_each(df)
    assert out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert {i for i, _ in lone} <= set(kept)
    assert sum(sum(i in kept for i in g) == 1 for g in groups) >= 38
    assert all(g[0] in kept for g in groups)
    assert sorted(i for i in kept if i is not None and 8000 <= i < 9000) == [8001, 8003] and kept.count(None) == 1
    assert S.keep_one_of_each(docs([])).count() == 0


def jaccard(x, y):
    x, y = (set(zip(*(t.lower().split()[k:] for k in range(5)))) for t in (x, y))
    return len(x & y) / len(x | y)


def test_near_copies_of_long_texts_go(docs):
    """Similarities of little over 0.8, which a sample of a long text's parts tells badly."""
    rng, rows = random.Random(8), []
    for g in range(40):
        n = rng.choice([120, 500, 2000])
        w = [f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}" for _ in range(n)]
        c = list(w)
        for at in rng.sample(range(n), n):
            old, c[at] = c[at], f"new{rng.random()}"
            if jaccard(" ".join(w), " ".join(c)) < 0.8:
                c[at] = old
                break
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(c))]
    assert sorted(r["doc_id"] for r in S.keep_one_of_each(docs(rows)).collect()) == list(range(0, 80, 2))


def test_near_copies_in_a_family_go(spark, docs):
    """Texts by one template, of a similarity of about 0.6, whose every part some other has too; and
    a near copy of each."""
    rng, rows = random.Random(9), []
    for g in range(150):
        w = [f"t{i}" for i in range(300)]
        for at in range(0, 300, 10):
            w[at] += rng.choice("xy")
        c = list(w)
        for at in rng.sample(range(300), 5):
            c[at] = f"new{rng.random()}"
        assert jaccard(" ".join(w), " ".join(c)) >= 0.8
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(c))]
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = {i: S.fingerprint(t.encode(), 5) for i, t in rows}
    for a in sets:
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared) or ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    df = docs(rows)
    heads = sorted(i for i in parent if parent[i] == i)
    assert len(heads) > 100
    assert sorted(r["doc_id"] for r in S.keep_one_of_each(df).collect()) == heads
    light = S.stored(S.with_prefixes(df, 5, True), "fingerprints")
    texts = light.where("size(keys) > 0").dropDuplicates(["sid"])
    none = spark.createDataFrame([], "node long, component long")
    by_size = [{tuple(r) for r in S.with_near_copies(none, df, light, texts, 5, size).collect()} for size in (2048, 7)]
    assert by_size[0] == by_size[1] and by_size[0]


def test_profiles_never_rule_out_what_is_shared():
    rng = np.random.default_rng(5)
    for n, m, both in ((0, 3, 0), (10, 12, 9), (300, 280, 250), (5000, 4100, 4000), (40, 4000, 40)):
        h = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64)
        x, y = (np.frombuffer(S.profile(v), np.uint8) for v in (h[:n], h[n - both :]))
        assert both <= S.most_shared(x, y) <= min(n, m)
    same = np.zeros(1000, np.uint64)
    assert S.most_shared(np.frombuffer(S.profile(same), np.uint8), np.frombuffer(S.profile(same), np.uint8)) is None


def test_equal_sets_of_different_fingerprints_are_one_group(docs):
    once = " ".join(f"w{i}" for i in range(60))
    rows = [(1, once), (2, " ".join([once] * 7)), (3, once + " " + " ".join(["w0 w1 w2 w3 w4 w5 w6"] * 9))]
    assert S.fingerprint(rows[0][1].encode(), 5) != S.fingerprint(rows[2][1].encode(), 5)
    kept = {r["doc_id"] for r in S.keep_one_of_each(docs(rows)).collect()}
    assert 1 in kept and 2 not in kept


def test_brief_profiles_keep_near_copies_and_rule_out_most_others():
    rng = np.random.default_rng(11)
    sets = [np.unique(rng.integers(0, 1 << 63, int(n)).astype(np.uint64)) for n in rng.integers(1, 4000, 60)]
    near = [np.unique(np.concatenate([h[len(h) // 12 :], rng.integers(0, 1 << 63, len(h) // 12).astype(np.uint64)])) for h in sets]
    every = sets + near
    brief = [S.folded(np.frombuffer(S.profile(h), np.uint8), S.BRIEF).tobytes() for h in every]
    assert max(map(len, brief)) == S.BRIEF
    i, j = (v.ravel() for v in np.meshgrid(np.arange(len(every)), np.arange(len(every))))
    sizes = np.array([len(h) for h in every])
    good = S.briefly_alike(brief, brief, i, j, sizes[i] + sizes[j])
    true = np.array([S.SHARED * len(np.intersect1d(every[a], every[b])) >= S.OF * (len(every[a]) + len(every[b])) for a, b in zip(i, j, strict=True)])
    assert not (true & ~good).any() and true.sum() > 120
    close = np.minimum(sizes[i], sizes[j]) >= 0.8 * np.maximum(sizes[i], sizes[j])
    large = (sizes[i] > 100) & (sizes[i] < 2000)
    assert good[close & large & ~true].mean() < 0.2
    same = np.full(2000, 3, np.uint64)
    full = S.folded(np.frombuffer(S.profile(same), np.uint8), S.BRIEF).tobytes()
    assert S.briefly_alike([full], [full], np.array([0]), np.array([0]), np.array([99])).all()


def test_heavy_fingerprints_are_joined_where_they_are(docs, monkeypatch):
    rng = random.Random(31)
    rows = [(i, "the same text of some words") for i in range(50)] + [(100 + i, " ".join(rng.choice("abcdefgh") for _ in range(30))) for i in range(40)] + [(None, None), (5, None)]
    runs = []
    for heavy in (1000, 2, 0):
        monkeypatch.setattr(S, "HEAVY", heavy)
        runs.append(sorted((tuple(r) for r in S.near_duplicates(docs(rows)).collect()), key=str))
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == len(rows)
