"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position of a fingerprint gets a vector of radius + 1 bits, and every nonzero vector v
gives a table whose mask holds the positions with an odd inner product with v. Up to radius
differing positions span less than the whole space, so some v is orthogonal to all of them: in that
table the two fingerprints agree under the mask. No pair within the radius is missed.

Distinct fingerprints alone go into the tables. A bucket of two is compared by an expression; the
rows of a larger bucket are dealt into lists of bounded length, and a list gives the edges of a
spanning forest of its links, not all its pairs. What the dealing parted is compared after the
components are known: only rows outside a bucket's main component are held against all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import forget, free_names, let_go, stored
from millrace.llm.components import connected_components

SEED = 42
#: Fingerprints that a list holds, about.
LIST_ROWS = 4096
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64 bits, as a signed number, of the majority over the hashes of the word shingles of an
    UTF-8 text, A-Z lower-cased; a short text is one shingle, one without words has no bits."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= shingle:
        shingles = iter((b" ".join(w),))
    else:
        shingles = map(b" ".join, zip(*(w[k:] for k in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        some = hashes[at : at + CHUNK]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, a row per row; null is the text without words."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(compute, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """2 ** (radius + 1) - 1 masks as signed numbers; position i has the vector i mod (their number), plus 1."""
    n = (1 << radius + 1) - 1
    masks = []
    for v in range(1, n + 1):
        m = sum(1 << i for i in range(64) if ((i % n + 1) & v).bit_count() & 1)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges (member, first of its component) of the graph that links what differs in ``radius`` bits
    or fewer. A search from each node over the nodes not yet reached: links are never listed."""
    left, ends, starts = np.sort(fps).view(np.uint64), [], []
    while len(left) > 1:
        first, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= radius
            if near.any():
                new = left[near]
                ends += new.tolist()
                starts += [first] * len(new)
                front += list(new)
                left = left[~near]
    return np.array(ends, np.uint64).view(np.int64).tolist(), np.array(starts, np.uint64).view(np.int64).tolist()


def list_edges(rows: DataFrame, by: list[str], radius: int) -> DataFrame:
    """a, b: the forests of the lists that ``by`` groups the column fp of ``rows`` into."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [forest(np.array(x.as_py(), np.int64), radius) for x in batch.column(0)]
            a, b = [x for p in pairs for x in p[0]], [x for p in pairs for x in p[1]]
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    lists = rows.groupBy(*by).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return lists.select("fps").mapInArrow(links, "a long, b long").distinct()


def linked(distinct: DataFrame, radius: int, list_rows: int = LIST_ROWS) -> DataFrame:
    """node, component over the column fp of ``distinct`` (no repeats); see ``connected_components``."""
    tables = F.array(*(F.xxhash64(F.lit(v), F.col("fp").bitwiseAND(F.lit(m))) for v, m in enumerate(covering_masks(radius))))
    rows = distinct.select("fp", F.explode(tables).alias("key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    buckets = stored(buckets, "buckets")
    pairs = buckets.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    members = rows.join(buckets.where("n > 2").select("key", "n"), "key")
    members = members.withColumn("lists", F.ceil(F.col("n") / list_rows).cast("int"))
    # The salt differs from table to table, so that lists of one group mix.
    members = stored(members.withColumn("salt", F.pmod(F.xxhash64("fp", "key"), F.col("lists")).cast("int")), "bucket-rows")
    edges = pairs.unionByName(list_edges(members, ["key", "salt"], radius))
    edges = stored(edges, "links")
    found = connected_components(edges)

    hot = members.where("lists > 1").select("key", "fp", "lists", "salt")
    if hot.isEmpty():
        return found
    found = stored(found, "components")
    marked = hot.join(found, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp")).drop("node")
    marked = stored(marked, "hot-rows")
    sizes = marked.groupBy("key", "component").count()
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("m"))
    main = main.where("n > m").select("key", "main", F.ceil((F.col("n") - F.col("m")) / list_rows).cast("int").alias("others"))
    marked = marked.join(main, "key")
    other = F.col("component") != F.col("main")
    queries = marked.where(other).withColumn("part", F.pmod(F.xxhash64("key", "fp"), F.col("others")).cast("int"))
    queries = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("lists") - 1))).select("key", "fp", "salt", "part")
    base = marked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).select("key", "fp", "salt", "part")
    more = stored(list_edges(queries.unionByName(base), ["key", "salt", "part"], radius), "links")
    if more.isEmpty():
        return found
    return connected_components(edges.unionByName(more))


def near_duplicates(df: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fp, fingerprint (16 hex digits) and component_id.

    Fingerprints of ``radius`` or fewer differing bits link; component_id is the smallest doc_id
    that is reached over links, null where only null ids are. Null and empty texts have the
    fingerprint zero and link like any other; repeated rows stay; an empty table gives an empty
    result; extra columns are left behind.
    """
    docs = stored(fingerprints(df, shingle, id_col, text_col), "fingerprints")
    distinct = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "distinct-fingerprints")
    found = linked(distinct.select("fp"), radius)
    named = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", "rows", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stored(named.join(least, "component").select("fp", "component_id", "rows"), "named-fingerprints")
    # Fingerprints that each have more than a thousandth of the rows are fewer than a thousand; their
    # rows stay where they are.
    n = distinct.agg(F.sum("rows")).first()[0] or 0
    heavy, light = (named.where(w).drop("rows") for w in (F.col("rows") * HEAVY > n, F.col("rows") * HEAVY <= n))
    rest = docs.join(F.broadcast(heavy.select("fp")), "fp", "left_anti")
    out = docs.join(F.broadcast(heavy), "fp").unionByName(rest.join(light, "fp"))
    forget(distinct)
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: A fingerprint is heavy if its rows, so many times, are more than all.
HEAVY = 1000
#: Texts are near copies from this Jaccard similarity of their shingles on, in ninths of the sum of
#: their shingles: 5 * shared >= 4 * (n + m - shared), which is 0.8.
SHARED, OF = 9, 4
#: Sets that a task remembers, so that texts of equal shingles give their keys once.
SEEN = 200_000
#: Texts of the sample that tells frequent shingles, and the most shingles that it names. Any order
#: of shingles gives the same links; frequent ones come last, so that few texts meet by them.
SAMPLE_TEXTS, MOST_FREQUENT = 8_000, 200_000
#: Texts of a list that is compared with another, about.
MEET_ROWS = 2048
#: Rows of two longs up to which a table is broadcast.
BROADCAST_ROWS = 200_000
#: A count of a profile that may stand for more; classes of a brief profile.
FULL, BRIEF = 255, 256
#: Pairs whose brief profiles are held against each other at once.
BRIEF_PAIRS = 1 << 14


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, cut as ``fingerprint`` cuts them."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[k:] for k in range(shingle)), strict=False)) if len(w) > shingle else iter((b" ".join(w),))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def prefix(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first fifth of a set, and one more, rarest first.

    Two sets of a similarity of 0.8 share four fifths of either at least. All that they share comes
    last in neither, so the smallest shared shingle is within the first n // 5 + 1 of both."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        hashes = hashes[np.lexsort((hashes, np.where(frequent[at] == hashes, counts[at], 0)))]
    return hashes[: len(hashes) // 5 + 1]


def frequent_shingles(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of shingles that three texts of a bounded sample have."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.record_batch([pa.array(shingle_set(t.as_py(), shingle).view(np.int64))], ["hash"])

    every = rows.count() // SAMPLE_TEXTS + 1
    some = rows.where(F.pmod("_key", F.lit(every)) == 0).dropDuplicates(["_key"]).limit(2 * SAMPLE_TEXTS).select("text")
    found = some.mapInArrow(compute, "hash long").groupBy("hash").count().where("count > 2").orderBy(F.desc("count"), "hash").limit(MOST_FREQUENT).toArrow()
    hashes, counts = found["hash"].to_numpy().astype(np.int64).view(np.uint64), found["count"].to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def keyed_texts(df: DataFrame) -> DataFrame:
    """doc_id, _key (a hash of the text) and text as bytes."""
    text = F.coalesce("text", F.lit(""))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_key"), text.cast("binary").alias("text"))


def profile(hashes: np.ndarray) -> bytes:
    """How many hashes of a set fall into each of as many classes as the set has quarters of hashes,
    about; classes by the low bits, so that a longer profile folds onto a shorter one."""
    classes = 1 << min(20, max(4, (len(hashes) // 4).bit_length()))
    counts = np.bincount((hashes & np.uint64(classes - 1)).astype(np.int64), minlength=classes)
    return np.minimum(counts, FULL).astype(np.uint8).tobytes()


def most_shared(x: np.ndarray, y: np.ndarray) -> int | None:
    """No more hashes than this can two sets share, by their profiles; None if these can't tell."""
    if x.max() == FULL or y.max() == FULL:
        return None
    n = min(len(x), len(y))
    x, y = (v.reshape(-1, n).sum(axis=0, dtype=np.int64) for v in (x, y))
    return int(np.minimum(x, y).sum())


def folded(profile: np.ndarray, classes: int) -> np.ndarray:
    """A profile over fewer classes, or itself; ``FULL`` stays what may stand for more."""
    if len(profile) <= classes:
        return profile
    parts = profile.reshape(-1, classes)
    return np.where((parts == FULL).any(axis=0), FULL, np.minimum(parts.sum(axis=0, dtype=np.int64), FULL)).astype(np.uint8)


def briefly_alike(x: list[bytes], y: list[bytes], i: np.ndarray, j: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which pairs (x[i], y[j]) of brief profiles allow a similarity of 0.8, where the sets of a pair have
    so many hashes together; the same bound as by whole profiles, only looser."""
    out = np.ones(len(i), bool)
    p, q = (np.array([len(v) for v in side]) for side in (x, y))
    for a in np.unique(p[i]).tolist():
        for b in np.unique(q[j]).tolist():
            some = np.flatnonzero((p[i] == a) & (q[j] == b))
            if not len(some):
                continue
            m = min(a, b)
            rows, other = ({k: folded(np.frombuffer(side[k], np.uint8), m) for k in np.unique(at[some]).tolist()} for side, at in ((x, i), (y, j)))
            u, v = (np.stack(list(r.values())) for r in (rows, other))
            iu, jv = np.searchsorted(list(rows), i[some]), np.searchsorted(list(other), j[some])
            for k in range(0, len(some), BRIEF_PAIRS):
                part = slice(k, k + BRIEF_PAIRS)
                one, two = u[iu[part]], v[jv[part]]
                known = (one != FULL).all(axis=1) & (two != FULL).all(axis=1)
                most = np.minimum(one, two).sum(axis=1, dtype=np.int64)
                out[some[part]] = ~known | (SHARED * most >= OF * sizes[some[part]])
    return out


def with_prefixes(df: DataFrame, shingle: int, parts: bool) -> DataFrame:
    """doc_id, _key, fp, sid (a hash of the shingle set), n (its size), keys (its prefix) and profile,
    a row per row. Equal sets that one task meets have keys and profile once, and without ``parts``
    no text has any."""
    rows = keyed_texts(df)
    frequent, times = frequent_shingles(rows, shingle) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                fps, sids, sizes, keys, profiles = [], [], [], [], []
                for t in some.column(2):
                    text = t.as_py()
                    fps.append(fingerprint(text, shingle))
                    hashes = shingle_set(text, shingle) if parts else np.zeros(0, np.uint64)
                    sid = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
                    sids.append(sid - (1 << 64) if sid >> 63 else sid)
                    sizes.append(len(hashes))
                    first = sid not in seen and len(hashes) > 0
                    keys.append(prefix(hashes, frequent, times).view(np.int64) if first else [])
                    profiles.append(profile(hashes) if first else None)
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(sid)
                columns = [pa.array(fps, pa.int64()), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(profiles, pa.binary())]
                yield pa.record_batch([some.column(0), some.column(1), *columns], ["doc_id", "_key", "fp", "sid", "n", "keys", "profile"])

    return rows.mapInArrow(compute, "doc_id long, _key long, fp long, sid long, n int, keys array<long>, profile binary")


def may_be_alike(n, m, at, to):  # noqa: ANN001, ANN201
    """Whether sets of n and m shingles may be near copies if the places ``at`` and ``to`` of their
    orders hold the same shingle, the first that they share: no more than what follows is shared."""
    least = np.minimum if isinstance(n, np.ndarray) else F.least
    return SHARED * least(n - at, m - to) >= OF * (n + m)


def alike(pairs: DataFrame, df: DataFrame, light: DataFrame, shingle: int) -> DataFrame:
    """Those of the ``pairs`` (a and b are sids) whose sets have a similarity of 0.8 or more."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for sid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if sid not in done:
                    yield pa.record_batch([pa.array([sid], pa.int64()), pa.array([shingle_set(text.as_py(), shingle).tobytes()], pa.binary())], ["sid", "hashes"])
                if len(done) >= SEEN:
                    done.clear()
                done.add(sid)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                good.append(SHARED * len(np.intersect1d(x, y, assume_unique=True)) >= OF * (len(x) + len(y)))
            yield pa.record_batch(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = stored(light.join(wanted, "sid").groupBy("sid").agg(F.min("_key").alias("_key")), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    texts = keyed_texts(df).select("_key", "text").join(F.broadcast(wanted) if few else wanted, "_key").select("sid", "text")
    sets = stored(texts.mapInArrow(compute, "sid long, hashes binary").dropDuplicates(["sid"]), "shingle-sets")
    left, right = (sets.select(F.col("sid").alias(c), F.col("hashes").alias(f"{c}_set")) for c in "ab")
    found = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set").mapInArrow(test, "a long, b long")
    found = stored(found, "alike")
    forget(sets)
    forget(wanted)
    return found


def apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The ``pairs`` whose ends have different components, as ca and cb, and whose profiles allow a
    similarity of 0.8. ``components``: sid, component, n, profile."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (np.asarray(batch.column(k)).astype(np.int64) for k in ("na", "nb"))
            good = []
            for x, y, size in zip(batch.column("pa"), batch.column("pb"), (n + m).tolist(), strict=True):
                most = most_shared(*(np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y)))
                good.append(most is None or SHARED * most >= OF * size)
            yield pa.record_batch(batch.columns[:4], ["a", "b", "ca", "cb"]).filter(pa.array(good, pa.bool_()))

    for c in "ab":
        pairs = pairs.join(components.select(F.col("sid").alias(c), F.col("component").alias(f"c{c}"), F.col("n").alias(f"n{c}"), F.col("profile").alias(f"p{c}")), c)
    near = SHARED * F.least("na", "nb") >= OF * (F.col("na") + F.col("nb"))
    rows = pairs.where((F.col("ca") != F.col("cb")) & near).select("a", "b", "ca", "cb", "na", "nb", "pa", "pb")
    return rows.mapInArrow(test, "a long, b long, ca long, cb long")


def parted_pairs(members: DataFrame, components: DataFrame, sets: DataFrame, list_rows: int) -> DataFrame:
    """a, b: pairs of sids that share a key, may be near copies by their brief profiles too, and have
    different components, less those with a bucket's head. Of a bucket only rows outside its main
    component are held against all; both sides are dealt into lists of about ``list_rows``, and every
    two lists meet. ``sets``: sid, profile."""

    def brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [folded(np.frombuffer(v.as_buffer(), np.uint8), BRIEF).tobytes() for v in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(short, pa.binary())], ["sid", "brief"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                *v, briefs = x.values.flatten()
                v, briefs = [c.to_numpy() for c in v], briefs.to_pylist()
                asks = v[5]
                q, b = ([c[some] for c in v[:5]] for some in (asks == 1, asks == 0))
                own, other = ([briefs[k] for k in np.flatnonzero(some)] for some in (asks == 1, asks == 0))
                for k in range(0, len(q[0]), 256):
                    sid, n, at, component, _ = (c[k : k + 256, None] for c in q)
                    # Two rows outside the main component would meet twice.
                    good = may_be_alike(n, b[1], at, b[2]) & (component != b[3]) & ((b[4] == 0) | (sid < b[0]))
                    i, j = np.nonzero(good)
                    if len(i):
                        near = briefly_alike(own[k : k + 256], other, i, j, n[i, 0] + b[1][j])
                        yield pa.record_batch([pa.array(sid[i[near], 0]), pa.array(b[0][j[near]])], ["a", "b"])

    marked = members.where("sid <> head").select("key", "sid", F.col("n").cast("long"), F.col("at").cast("long"))
    marked = stored(marked.join(components, "sid"), "bucket-rows")
    sizes = marked.groupBy("key", "component").count()
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("most"))
    lists = lambda c: F.ceil(c / list_rows).cast("int")
    main = main.where("all > most").select("key", "main", lists(F.col("all")).alias("lists"), lists(F.col("all") - F.col("most")).alias("others"))
    marked = marked.join(main, "key").withColumn("other", (F.col("component") != F.col("main")).cast("long"))
    marked = marked.join(sets.select("sid", "profile").mapInArrow(brief, "sid long, brief binary"), "sid")
    dealt = lambda c: F.pmod(F.xxhash64("key", "sid"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    row = lambda asks: F.struct("sid", "n", "at", "component", "other", F.lit(asks).cast("long").alias("asks"), "brief").alias("row")
    asking = marked.where("other = 1").select("key", every("lists").alias("salt"), dealt("others").alias("part"), row(1))
    base = marked.select("key", dealt("lists").alias("salt"), every("others").alias("part"), row(0))
    rows = asking.unionByName(base).groupBy("key", "salt", "part").agg(F.collect_list("row").alias("rows"))
    return rows.select("rows").mapInArrow(meet, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def with_near_copies(found: DataFrame, df: DataFrame, light: DataFrame, sets: DataFrame, shingle: int, list_rows: int = MEET_ROWS) -> DataFrame:
    """``found`` (node, component over fingerprints) with the links of texts of a similarity of 0.8 or
    more. Near copies share a key; who shares one is held against each other by profiles, which rule
    out nearly all others, and then compared by the whole sets.

    In each bucket of equal keys every text is first held against three of it, which joins most of a
    large family by no more pairs than thrice the bucket's texts. Then those that are still apart are
    held against each other, whoever heads their buckets."""
    spark = df.sparkSession
    buckets = sets.select("sid", F.explode("keys").alias("key")).groupBy("key")
    buckets = buckets.agg(F.count(F.lit(1)).alias("size"), F.min("sid").alias("a"), F.max("sid").alias("b")).where("size > 1")
    buckets = stored(buckets, "buckets")
    let_go(spark)
    large = buckets.where("size > 2").select("key", "size", F.col("a").alias("head"))
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    members = sets.select("sid", "n", F.posexplode("keys").alias("at", "key")).join(large, "key")
    members = stored(members, "members")
    let_go(spark)
    place = light.select("sid", "fp").distinct()

    def components(found: DataFrame) -> DataFrame:
        named = place.join(found, F.col("fp") == F.col("node"), "left").select("sid", F.coalesce("component", "fp").alias("component"))
        # One set may have several fingerprints: any of them stands for it, as they are linked below.
        return stored(named.groupBy("sid").agg(F.min("component").alias("component")), "components")

    def joined(found: DataFrame, now: DataFrame, pairs: DataFrame) -> DataFrame:
        pairs = stored(apart(pairs, now.join(sets.select("sid", "n", "profile"), "sid")), "candidates")
        let_go(spark)
        links = alike(pairs, df, light, shingle).join(pairs, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        links = stored(links.distinct(), "near-copies")
        forget(pairs)
        let_go(spark)
        return found if links.isEmpty() else connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))

    # Equal sets of different fingerprints: texts that repeat shingles unequally often.
    span = place.groupBy("sid").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a < b").select("sid", "a")
    equal = stored(place.join(span, "sid").where("fp <> a").select(F.col("fp").alias("a"), F.col("a").alias("b")).distinct(), "equal-sets")
    if not equal.isEmpty():
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(equal))
    # The text of the smallest sid, the one whose keys most others have, and the one of the smallest hash.
    weight = members.groupBy("sid").agg(F.sum("size").alias("weight"))
    row = ("sid", "n", "at")
    head = members.join(F.broadcast(weight) if weight.count() <= BROADCAST_ROWS else weight, "sid").groupBy("key").agg(
        F.min(F.struct(*row)).alias("least"), F.max(F.struct("weight", *row)).alias("central"), F.min(F.struct(F.xxhash64("sid").alias("hash"), *row)).alias("any")
    )
    head = stored(head.select("key", F.array("least", *(F.struct(*(f"{c}.{x}" for x in row)) for c in ("central", "any"))).alias("first")), "heads")
    heads = members.join(F.broadcast(head) if head.count() <= BROADCAST_ROWS else head, "key").withColumn("first", F.explode("first"))
    heads = heads.where((F.col("sid") != F.col("first.sid")) & may_be_alike(F.col("n"), F.col("first.n"), F.col("at"), F.col("first.at")))
    heads = heads.select(F.least("first.sid", "sid").alias("a"), F.greatest("first.sid", "sid").alias("b"))
    pairs = buckets.where("size = 2").select("a", "b").unionByName(heads).distinct()
    now = components(found)
    found = joined(found, now, pairs)
    forget(now)
    forget(head)
    forget(buckets)
    now = components(found)
    found = joined(found, now, parted_pairs(members, now, sets, list_rows))
    forget(members)
    return found


def keep_one_of_each(df: DataFrame, shingle: int = 5, radius: int = 4, parts: bool = True) -> DataFrame:
    """The rows of ``df`` (doc_id, text and more) less all but one of every group of near duplicates.

    Fingerprints within ``radius`` link; with ``parts`` also those of texts of a similarity of 0.8
    or more, which whole fingerprints of 64 bits seldom bring so near. Of a group the row of the
    smallest id stays, null counting as the largest, then of the smallest text hash; of equal rows
    one stays. All texts without words are one group. Columns stay as they are.
    """
    texts = stored(with_prefixes(df, shingle, parts), "shingled-texts")
    light = stored(texts.select("doc_id", "_key", "fp", "sid"), "fingerprints")
    if parts:
        sets = stored(texts.where("size(keys) > 0").dropDuplicates(["sid"]).select("sid", "n", "keys", "profile"), "shingle-prefixes")
    forget(texts)
    found = linked(light.select("fp").distinct(), radius)
    let_go(df.sparkSession)
    if parts:
        found = with_near_copies(stored(found, "by-radius"), df, light, sets, shingle)
        forget(sets)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_key").alias("key"))
    first = light.groupBy("fp").agg(F.min(order).alias("first"))
    named = first.join(found, F.col("fp") == F.col("node"), "left").select("first", F.coalesce("component", "fp").alias("component"))
    kept = named.groupBy("component").agg(F.min("first").alias("first"))
    kept = stored(kept.select(F.col("first.none").alias("_none"), F.coalesce("first.id", F.lit(0)).alias("_id"), F.col("first.key").alias("_kept")), "kept")
    row, none, own, text = free_names(df, "row_hash", "kept_none", "kept_id", "kept_hash")
    kept = kept.toDF(none, own, text)
    keyed = df.withColumn(row, F.xxhash64(F.coalesce("text", F.lit(""))))
    on = (keyed.doc_id.isNull() == F.col(none)) & (F.coalesce(keyed.doc_id.cast("long"), F.lit(0)) == F.col(own)) & (F.col(row) == F.col(text))
    out = keyed.join(kept, on, "left_semi")
    if not light.groupBy("doc_id", "_key").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", row])
    return out.select(*df.columns)
