"""Stored indexes: what they find against all rows, what a plan reads, what a refresh rewrites."""

import datetime
import os
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import postings as P
from millrace.operators import retrieval as R
from millrace.operators import vector_index as V

SF = "/root/testdata/sf0.001"
KINDS = "vec_id long, embedding array<float>"


def clustered(n=3000, size=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, size))
    return [(i, (centres[rng.integers(0, 40)] + 0.7 * rng.normal(size=size)).astype(np.float32).tolist()) for i in range(n)]


def found(df):
    return {(r["query_id"], r["rank"]): (r["vec_id"], round(r["similarity"], 6)) for r in df.collect()}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    items = spark.createDataFrame(clustered(), KINDS).cache()
    return V.build_index(items, str(tmp_path_factory.mktemp("ivf") / "i"), lists=50), items


def test_all_lists_give_the_exact_answer(index):
    built, items = index
    queries = items.where("vec_id % 20 = 0")
    assert found(V.search_index(built, queries, 5)) == found(R.vector_topk(queries, items, 5))


def test_recall_and_pruned_folders(index, spark):
    built, items = index
    queries = items.where("vec_id % 20 = 0")
    probes = V.probes_for(built, queries, 5, 0.95)
    assert 1 <= probes < built.lists / 2
    out = V.search_index(built, queries, 5, probes)
    exact, got = R.vector_topk(queries, items, 5), {(r["query_id"], r["vec_id"]) for r in out.collect()}
    hits = [(r["query_id"], r["vec_id"]) in got for r in exact.collect()]
    assert sum(hits) / len(hits) >= 0.9
    one = V.search_index(built, items.where("vec_id = 7"), 5, 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    assert len(re.search(r"list#\d+ IN \(([^)]*)\)", filters)[1].split(",")) == 2


def test_the_large_way_finds_the_same(index, monkeypatch):
    built, items = index
    queries = items.where("vec_id % 60 = 0")
    small = [found(V.search_index(built, queries, 5, p)) for p in (None, 4)]
    monkeypatch.setattr(V, "BROADCAST_VALUES", 1)
    assert [found(V.search_index(built, queries, 5, p)) for p in (None, 4)] == small


@pytest.mark.parametrize("bound", [10**9, 1])
def test_scopes_and_windows(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(V, "BROADCAST_VALUES", bound)
    day = lambda d: datetime.date(2024, 1, d)
    v = [1.0, 0.0]
    rows = [(1, v, "a", None, None), (2, v, "a", day(5), None), (3, v, "b", None, None), (4, v, "a", None, day(10)), (5, [0.0, 0.0], "a", None, None), (6, None, "a", None, None), (7, [1.0], "a", None, None), (None, v, "a", None, None), (8, v, None, None, None), (9, [0.0, 1.0], "a", day(10), day(11))]
    items = spark.createDataFrame(rows, f"{KINDS}, shop string, since date, until date")
    built = V.build_index(items, str(tmp_path / "i"), lists=3, scope=("shop", "since", "until"))
    asked = [(1, v, "a", day(10)), (2, v, "a", day(4)), (3, v, "b", day(1)), (4, v, None, day(1)), (5, v, "a", None)]
    queries = spark.createDataFrame(asked, f"{KINDS}, shop string, day date")
    got = {}
    for r in V.search_index(built, queries, 9, valid=("since", "until"), on="day").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["similarity"]))
    zero = [(5, 0.0), (6, 0.0), (7, 0.0)]
    assert got == {1: [(2, 1.0), *zero, (9, 0.0)], 2: [(1, 1.0), (4, 1.0), *zero]}


def test_odd_vector_tables(spark, tmp_path):
    none = spark.createDataFrame([], KINDS)
    built = V.build_index(none, str(tmp_path / "none"))
    some = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0])], KINDS)
    assert built.lists == 0 and V.search_index(built, some, 5).count() == 0
    built = V.build_index(some, str(tmp_path / "some"))
    assert V.search_index(built, none, 5).count() == 0
    assert [(r["query_id"], r["vec_id"]) for r in V.search_index(built, some.where("vec_id = 1"), 5).orderBy("rank").collect()] == [(1, 2), (1, 3)]


def tops(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["overlap"], round(r["score"], 6)) for r in df.collect())


def written(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


@pytest.fixture
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")


def test_a_refresh_rewrites_changed_shops_only(spark, corpus, tmp_path):
    docs, items = corpus
    path = str(tmp_path / "p")
    assert {r["action"] for r in P.refresh_postings(docs, path, "source", "doc_id").collect()} == {"added"}
    before = written(f"{path}/postings")
    assert {r["action"] for r in P.refresh_postings(docs, path, "source", "doc_id").collect()} == {"kept"}
    assert written(f"{path}/postings") == before
    shop, other = [r[0] for r in docs.select("source").distinct().orderBy("source").limit(2).collect()]
    changed = docs.where((F.col("source") != other) | (F.col("doc_id") % 2 == 0)).withColumn("text", F.when(F.col("source") == shop, F.concat("text", F.lit(" added words"))).otherwise(F.col("text")))
    changed = changed.where(F.col("source") != other)
    actions = {r["shop"]: r["action"] for r in P.refresh_postings(changed, path, "source", "doc_id").collect()}
    assert actions.pop(shop) == "rewritten" and actions.pop(other) == "dropped" and set(actions.values()) == {"kept"}
    after = written(f"{path}/postings")
    assert all(after[p] == t for p, t in before.items())
    assert {Path(p).parent.parent.name for p in after if p not in before} == {f"shop={shop}"}
    assert tops(P.postings_topk(items, path, "item_id")) == tops(R.lexical_topk(items, changed, "item_id", "doc_id"))


def test_a_refresh_cut_short_changes_nothing(spark, corpus, tmp_path):
    docs, items = corpus
    path = str(tmp_path / "p")
    P.refresh_postings(docs, path, "source", "doc_id").collect()
    expected = tops(P.postings_topk(items, path, "item_id"))
    later = docs.withColumn("text", F.concat("text", F.lit(" more")))
    P.refresh_postings(later, path, "source", "doc_id").collect()
    # The second manifest is lost, its folders are there: as if the job had ended before it.
    for p in Path(f"{path}/manifest/version=2").iterdir():
        os.remove(p)
    os.rmdir(f"{path}/manifest/version=2")
    assert tops(P.postings_topk(items, path, "item_id")) == expected
    P.refresh_postings(later, path, "source", "doc_id").collect()
    assert tops(P.postings_topk(items, path, "item_id")) == tops(R.lexical_topk(items, later, "item_id", "doc_id"))


@pytest.mark.parametrize("bound", [10**9, 1])
def test_postings_of_odd_rows_and_the_large_way(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(P, "BROADCAST_TOKENS", bound)
    monkeypatch.setattr(P, "PART_BYTES", 8)
    rows = [(1, "a b c", "s"), (2, "a b", "s"), (3, None, "s"), (None, "a b c", "s"), (4, "a b c", None), (5, "", "t"), (6, "c c c", "t"), (7, "退货政策", "t"), (8, "a", "u/v=w %")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    path = str(tmp_path / "p")
    P.refresh_postings(docs, path, "source", "doc_id")
    asked = spark.createDataFrame([(1, "A b, c"), (2, "货政"), (3, ""), (4, None), (None, "a"), (5, "zzz")], "item_id long, text string")
    got = tops(P.postings_topk(asked, path, "item_id"))
    assert got == tops(R.lexical_topk(asked, docs.where("source IS NOT NULL"), "item_id", "doc_id"))
    assert {r[2] for r in got if r[0] == 1} == {1, 2, 6, 8}
    assert {r["doc_id"] for r in P.postings_topk(asked, path, "item_id", shops=["t"]).collect()} == {6, 7}
    empty = docs.where("false")
    assert {r["action"] for r in P.refresh_postings(empty, path, "source", "doc_id").collect()} == {"dropped"}
    assert P.postings_topk(asked, path, "item_id").count() == 0


def test_issues_of_embeddings(spark):
    good = [(0, 0.5), (3, 0.1)]
    rows = [(1, [1.0, 2.0], good), (2, [1.0], good), (3, None, None), (4, [1.0, None], []), (5, [1.0, float("inf")], [(-1, 1.0), (2, None)]), (6, [1.0, 2.0], [(7, 1.0), (7, 2.0), (None, 1.0)]), (7, [1.0, 2.0], good), (7, [1.0, 2.0], good), (9, [1.0, 2.0], good)]
    got = spark.createDataFrame(rows, "id int, dense array<double>, sparse array<struct<token_id: long, weight: double>>")
    asked = spark.createDataFrame([(k,) for k in range(1, 9)], "id int")
    found = {}
    for r in V.embedding_issues(asked, got, "id", 2).collect():
        found.setdefault(r["id"], []).append(r["issue"])
    assert {k: sorted(v) for k, v in found.items()} == {
        2: ["dense_dimensions"], 3: ["dense_dimensions", "sparse_missing"], 4: ["dense_not_finite", "sparse_missing"], 5: ["dense_not_finite", "sparse_token_invalid", "sparse_weight_invalid"],
        6: ["sparse_token_invalid", "sparse_token_repeated"], 7: ["repeated_row"], 8: ["missing_row"], 9: ["unexpected_row"],
    }


def test_tokens_stay_where_their_texts_were_dealt(spark):
    """Only texts are shuffled to their parts; no exchange is dealt by tokens."""
    docs = spark.createDataFrame([("s", "f", i, f"word{i} common words") for i in range(20)] + [("s", "f", 20, "")], "shop string, fingerprint string, doc_id long, text string")
    lists = P.posting_lists(docs)
    got = {r["token"]: r["docs"] for r in lists.collect()}
    assert got["common"] == list(range(20)) and got["word7"] == [7] and "" not in got
    exchanges = [line for line in lists._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]
    assert exchanges and not any("token" in line for line in exchanges)
