"""Each stage of the pipeline against a plain version, on the smallest table."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, simhash, toxicity

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def rows(spark, small):
    """The input of each stage, as far as the stages before it leave it."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small).cache()
        out.append((name, docs))
    return {name: [r.asDict() for r in df.collect()] for name, df in out}


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages_and_columns(rows):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "piece_encoding"]
    for n in names[:-1]:
        assert set(rows[n][0]) == set(rows["documents"][0])


def test_toxic_documents_go(spark, small, rows):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{small}/labels.parquet"))
    automaton = lexicon.automaton()
    good = {r["doc_id"] for r in rows["documents"] if toxicity.score_of(toxicity.features(r["text"], automaton), lexicon.logistic) < 0.5}
    assert {r["doc_id"] for r in rows["toxicity"]} == good < {r["doc_id"] for r in rows["documents"]}


def test_one_of_each_group(rows):
    before, kept = rows["toxicity"], {r["doc_id"] for r in rows["simhash_near_dedup"]}
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    fps = {r["doc_id"]: simhash.fingerprint(r["text"].encode(), 5) & (1 << 64) - 1 for r in before}
    ids = sorted(sets)
    linked = defaultdict(set)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            j = len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] or sets[b] else 1.0
            if j >= 0.8 or (fps[a] ^ fps[b]).bit_count() <= 4:
                assert not (a in kept and b in kept)
            if j >= 0.55 or (fps[a] ^ fps[b]).bit_count() <= 4:
                linked[a].add(b)
                linked[b].add(a)
    gone = set(ids) - kept
    assert gone and all(linked[a] for a in gone)


def test_repeated_strings_go(rows):
    first, expected = {}, {}
    for r in sorted(rows["simhash_near_dedup"], key=lambda r: r["doc_id"]):
        b = r["text"].encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            s = b[k : k + 50]
            if s in first:
                gone[k : k + 50] = b"\1" * 50
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], r["doc_id"])
        text, at = "", 0
        for c in r["text"]:
            n = len(c.encode())
            if not all(gone[at : at + n]):
                text += c
            at += n
        expected[r["doc_id"]] = text
    assert {r["doc_id"]: r["text"] for r in rows["suffix_array_dedup"]} == expected
    assert all(r["n_chars"] == len(r["text"]) for r in rows["suffix_array_dedup"])


def test_sources_are_mixed(spark, rows):
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows["suffix_array_dedup"]], "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df).taken().collect() if r["taken"]}
    found = Counter()
    for r in rows["source_mixing"]:
        found[r["doc_id"]] += len(r["text"].split())
    assert found == taken


def test_pieces_decode_to_the_texts(rows):
    key = lambda x: (x[0], x[1])
    assert sorted(((r["doc_id"], r["decoded"]) for r in rows["piece_encoding"]), key=key) == sorted(((r["doc_id"], r["text"]) for r in rows["source_mixing"]), key=key)
    assert all(r["ids"] for r in rows["piece_encoding"] if r["decoded"])


def test_odd_rows(spark, docs, small):
    """Nulls, empty and repeated rows, another column of a clashing name, an empty table."""
    rows = [(None, None), (1, None), (2, ""), (3, " "), (4, "one two three"), (4, "one two three"), (5, "long " * 3000)]
    for df in (docs(rows).withColumn("_key", F.lit(1)).withColumn("component", F.lit("x")), docs([])):
        out = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, small).cache()
            assert out.columns == df.columns
            out.count()
        STAGES["piece_encoding"](spark, out, small).count()
