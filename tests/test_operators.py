import datetime as dt
import io
import random
import re
import zipfile

import numpy as np
import pytest

from millrace.operators import artifacts as A
from millrace.operators import integrity as I
from millrace.operators import metrics as M
from millrace.operators import retrieval as R
from millrace.operators import scope as S
from millrace.operators import snapshots as N
from millrace.sources import parsers as P

DOCS = "doc_id long, tenant_id string, shop_id string, disclosure_class string, effective_from date, effective_to date"


def day(n):
    return dt.date(2024, 1, n)


@pytest.fixture
def documents(spark):
    rows = [
        (1, "t", "a", "external_allowed", day(1), day(10)), (2, "t", "a", "external_allowed", day(10), None), (3, "t", "a", "internal_only", None, None),
        (4, "t", "a", "unclassified", None, None), (5, "t", "b", "external_allowed", None, None), (6, "u", "a", "external_allowed", None, None),
        (7, "t", "a", "external_allowed", day(9), day(9)),
    ]
    return spark.createDataFrame(rows, DOCS)


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_scopes(documents):
    scope = lambda **k: ids(S.in_scope(documents, S.Scope(**{"tenant": "t", "shops": ("a",), **k})))
    assert scope(on="2024-01-10") == [2] and scope(on="2024-01-09") == [1]
    assert scope() == [1, 2, 7] and scope(role="admin") == [1, 2, 3, 4, 7]
    assert scope(shops=()) == [] and scope(shop="b") == [] and scope(shops=("a", "b"), shop="b") == [5]
    assert scope(documents=()) == [] and scope(documents=(2, 5)) == [2]


def test_policy(spark, documents):
    asked = [(1, "t", "a", "viewer", day(10)), (2, "t", "a", "owner", day(12)), (3, "t", "a", "viewer", None), (4, "t", "zz", "viewer", day(1))]
    req = spark.createDataFrame(asked, "request_id int, tenant_id string, shop_id string, role string, on date")
    got = {(r["request_id"], r["doc_id"]): r["status"] for r in S.assess(documents, req).collect()}
    assert [got[1, i] for i in (1, 2, 3, 4, 5, 7)] == ["EXPIRED_OR_REVOKED", "ELIGIBLE", "ACCESS_DENIED", "UNCLASSIFIED_BLOCKED", "SCOPE_MISMATCH", "INVALID_POLICY"]
    assert got[2, 3] == "ELIGIBLE" and got[2, 4] == "UNCLASSIFIED_BLOCKED" and got[3, 1] == "INVALID_BUSINESS_DATE" and got[4, 1] == "SCOPE_MISMATCH"
    assert (1, 6) not in got


def test_gates(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, source string")
    access = [("shop", "a", 7, True), ("shop", "a", 8, False), ("shop", "b", 8, True), ("document", "2", 7, True)]
    access = spark.createDataFrame(access, "level string, resource string, principal int, granted boolean")
    got = {(r["principal"], r["doc_id"]) for r in S.through_gates(docs, access, {"shop": "source", "document": "doc_id"}).collect()}
    assert got == {(7, 1), (None, 3)}


def test_metrics_of_a_small_ranking(spark):
    rows = spark.createDataFrame([("q", "x", 0, 1, 0), ("q", "y", 1, 2, 1), ("q", "y", 1, 3, 2)], "query string, item string, relevance int, rank int, position int")
    kept = M.dedupe_rankings(rows, "query", "item", "relevance", "rank", "position")
    assert kept.count() == 2
    r = M.mean_metrics(M.query_metrics(kept, "query", "relevance", "rank")).first()
    assert (r["queries"], r["recall_1"], r["recall_5"], r["mrr"]) == (1, 0.0, 1.0, 0.5) and 0 < r["ndcg"] < 1
    empty = M.mean_metrics(M.query_metrics(kept.where("false"), "query", "relevance", "rank")).first()
    assert empty["queries"] == 0 and empty["mrr"] is None


def test_adjacent_chunks(spark):
    chunks = spark.createDataFrame([("d", i) for i in range(5)] + [("e", 2)], "doc string, pos int")
    hits = spark.createDataFrame([(1, 1, 0.9, "d", 2), (1, 2, 0.5, "d", 3)], "q int, rank int, score double, doc string, pos int")
    got = [(r["rank"], r["doc"], r["pos"], r["score"]) for r in R.with_adjacent(hits, chunks, ["doc"], "pos", "q").orderBy("rank").collect()]
    assert got == [(1, "d", 2, 0.9), (2, "d", 1, 0.9), (3, "d", 3, 0.9), (4, "d", 4, 0.5)]


def test_vectors_of_odd_shapes(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, [1.0]), (5, None)], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["rank"]) for r in R.vector_topk(rows.where("vec_id = 1"), rows, 3).orderBy("rank").collect()]
    assert got == [(2, 1), (3, 2), (4, 3)]
    assert R.vector_topk(rows.where("false"), rows, 3).count() == 0


def test_snapshots(spark):
    now = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, 1), (3, "c", 2)], "k int, v string, n int")
    assert {tuple(r) for r in N.upsert(now, new, "k", add=("n",)).collect()} == {(1, "a", 5), (2, None, 7), (3, "c", 2)}
    assert {tuple(r) for r in N.insert_missing(now, new, "k").collect()} == {(1, "a", 5), (2, "b", 6), (3, "c", 2)}
    gone = spark.createDataFrame([(1,)], "k int")
    assert {tuple(r) for r in N.replace_documents(now, new, gone, "k").collect()} == {(2, None, 1), (3, "c", 2)}


def test_publishing(spark):
    versions = [(1, 1, "active", "h1"), (1, 2, "approved", "h2"), (2, 1, "active", "x"), (2, 2, "approved", "y"), (3, 1, "superseded", "s"), (3, 2, "active", "t"), (4, 1, "revoked", "r")]
    versions = spark.createDataFrame(versions, "doc_id int, version_no int, state string, content_hash string")
    asked = [(1, 1, 2, "h2", "publish"), (2, 2, 2, "wrong", "publish"), (3, 3, 1, "s", "rollback"), (4, 4, 1, "r", "publish")]
    asked = spark.createDataFrame(asked, "seq int, doc_id int, version_no int, content_hash string, action string")
    after, audit = N.publish(versions, asked)
    got = {(r["doc_id"], r["version_no"]): r["state"] for r in after.collect()}
    assert got == {(1, 1): "superseded", (1, 2): "active", (2, 1): "active", (2, 2): "approved", (3, 1): "active", (3, 2): "superseded", (4, 1): "revoked"}
    assert {r["doc_id"]: r["applied"] for r in audit.collect()} == {1: True, 2: False, 3: True, 4: False}


def test_as_of(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, at int")
    right = spark.createDataFrame([(1, 2, 20.0), (1, 5, 50.0), (1, 5, 51.0), (3, 1, 1.0)], "k int, t int, v double")
    got = {(r["k"], r["at"]): r["as_of_v"] for r in N.as_of(left, right, "k", "at", "t", "v").collect()}
    assert got == {(1, 5): 51.0, (1, 1): None, (2, 9): None}


def test_rules(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "p"), (3, "z", "q")], "k int, v string, w string")
    b = spark.createDataFrame([(1, "x", None), (2, "n", "p"), (4, "z", "q")], "k int, v string, w string")
    got = {tuple(r) for r in I.changed_issues(a, b, "k", ["v", "w"], "r").collect()}
    assert got == {("r_v_changed", "2"), ("r_missing_right", "3"), ("r_missing_left", "4")}
    gate = {r["rule"]: r["ready"] for r in I.readiness(I.changed_issues(a, b, "k", ["v"], "r"), ["r_v_changed", "other"]).collect()}
    assert gate == {"r_v_changed": False, "other": True}


MARKDOWN = """intro

# One
text a
text b
## Two
- item 1
- item 2
| a | b |
|---|:---:|
| 1 | 2 |
![alt](img.png)
```py
code # not a heading
```
# Three
```
open"""


def elements(spark, form, content, **scope):
    kind = "binary" if isinstance(content, bytes) else "string"
    df = spark.createDataFrame([("d", content)], f"document_id string, content {kind}")
    return P.parse_documents(df, form, **scope).orderBy("element_index").collect()


def test_markdown(spark):
    got = [(r["kind"], r["text"], list(r["headings"]), r["first_line"], r["last_line"], r["warning"]) for r in elements(spark, "markdown", MARKDOWN)]
    assert got == [
        ("text", "intro", [], 1, 2, None), ("heading", "One", ["One"], 3, 3, None), ("text", "text a\ntext b", ["One"], 4, 5, None),
        ("heading", "Two", ["One", "Two"], 6, 6, None), ("list", "- item 1\n- item 2", ["One", "Two"], 7, 8, None), ("table", "a | b\n1 | 2", ["One", "Two"], 9, 11, None),
        ("image", "alt", ["One", "Two"], 12, 12, "image_reference_only"), ("code", "code # not a heading", ["One", "Two"], 13, 15, "code_language:py"),
        ("heading", "Three", ["Three"], 16, 16, None), ("code", "open", ["Three"], 17, 18, "unterminated_code_fence"),
    ]


def test_csv(spark):
    text = '\ufeffid,tenant_id,note\n\n1,t,"two\nlines"\n2,other,x\n3,,\n'
    got = [(r["text"], r["first_line"], r["last_line"]) for r in elements(spark, "csv", text, tenant="t")]
    assert got == [("id: 1\ntenant_id: t\nnote: two\nlines", 3, 4), ("id: 3", 6, 6)]
    for bad, error in (("a,a\n", "csv_header_duplicate"), ("a, \n", "csv_header_empty"), ("a,b\n1\n", "csv_column_mismatch:row=2")):
        assert [(r["kind"], r["text"]) for r in elements(spark, "csv", bad)] == [("error", error)]


def test_docx(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    xml = f"<w:document {w}><w:body>{p('Head', 'Heading1')}{p('Text')}<w:tbl>{row('a', 'b')}{row('1', '2')}{row('a', 'b')}</w:tbl></w:body></w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    got = [(r["kind"], r["text"], r["level"], r["warning"]) for r in elements(spark, "docx", data.getvalue())]
    assert got == [("heading", "Head", 1, None), ("text", "Text", None, None), ("table", "a | b\n1 | 2\na | b", None, "repeated_header_row")]
    assert elements(spark, "docx", b"no zip")[0]["kind"] == "error"


def test_html_elements(spark):
    page = "<h1>A  b</h1><script>x</script><p>one <b>two</b></p><ul><li>i</li></ul><table><tr><th>h</th><td>d</td></tr></table><pre>a\n  b</pre><img src='s.png'>"
    got = [(r["kind"], r["text"]) for r in elements(spark, "html", page)]
    assert got == [("heading", "A b"), ("text", "one two"), ("list", "i"), ("table", "h | d"), ("code", "a\n  b"), ("image", "s.png")]


def test_layout_and_strict_json(spark):
    content = '[{"type":"text","text":"T","text_level":1,"page_idx":0},{"category":"chart","content":"c","page_no":0},{"type":"table","table_body":[["a","b"],["1","2"]],"img_path":"p.png"}]'
    df = spark.createDataFrame([("d", content)], "document_id string, content string")
    got = [(r["kind"], r["text"], r["page_no"], list(r["image_refs"]), r["table_text"], r["warning"]) for r in P.normalize_layout(df).orderBy("element_index").collect()]
    assert got == [("heading", "T", 1, [], None, None), ("text", "c", None, [], None, "unknown_type:chart;invalid_page_no"), ("table", "", None, ["p.png"], "a | b\n1 | 2", None)]
    lines = spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',), ("[1]",), (" ",), ("{",)], "line string")
    assert [r["issue"] for r in P.strict_json(lines, "line").collect()] == [None, "invalid_json", "not_an_object", "blank", "invalid_json"]


def test_bundles(spark, tmp_path):
    docs = spark.createDataFrame([("t", "s", "v1", "text", None), ("t", "s", "v2", "text", "p")], "tenant string, shop string, version string, raw string, parsed string")
    rows = A.artifact_rows(docs, {"raw": "raw", "parsed": "parsed"}, "tenant", "shop", "version")
    assert rows.count() == 3 and len({r["set_hash"] for r in A.set_hash(rows, ["version"]).collect()}) == 2
    root = f"file://{tmp_path}/bundle"
    A.write_bundle(rows, root)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        A.write_bundle(rows, root)
    manifest, objects = spark.read.parquet(f"{root}/manifest"), spark.read.parquet(f"{root}/objects")
    assert {r["status"] for r in A.verify_bundle(manifest, objects).collect()} == {"ok"}
    assert sorted(r["status"] for r in A.verify_bundle(manifest, objects.where("kind = 'raw'")).collect()) == ["missing", "ok", "ok"]


def test_addresses_and_robots(spark):
    df = spark.createDataFrame([("8.8.8.8",), ("10.0.0.1",), ("::1",), ("no",), (None,)], "a string")
    assert [r["blocked"] for r in A.public_addresses(df, "a").collect()] == [False, True, True, True, True]
    text = "User-agent: other\nDisallow: /all\n\nuser-agent: mybot\nDisallow: /Private\nDisallow:\nUser-agent: mybot/2\nDisallow: /public\n"
    df = [(text, "/Private/a"), (text, "/private"), (text, "/public"), (text, "/all"), ("User-agent: *\r\nDISALLOW : /", "/x"), (None, "/x"), ("", "/x"), (text, None)]
    df = spark.createDataFrame(df, "robots string, path string")
    assert [r["allowed"] for r in A.robots_allow(df, "robots", "mybot", "path").collect()] == [False, True, True, True, False, True, True, True]


def naive_best(queries, items, limit):
    """Best items of each query by shared tokens, the first best part counting, plainly."""
    words = lambda t: set(re.findall("[a-z0-9_]+", (t or "").lower()))
    out = set()
    for k, q in queries:
        found = []
        for ids, parts in items:
            if None not in ids and parts is not None:
                n, at = max(((len(words(q) & words(p)), -i) for i, p in enumerate(parts)), default=(0, 0))
                found += [(-n, ids, -at)] if n else []
        out |= {(k, *ids, part, -n, r + 1) for r, (n, ids, part) in enumerate(sorted(found)[:limit])}
        out |= {(k, *ids, part, -n, None) for n, ids, part in found if -n == len(words(q))}
    return out


@pytest.mark.parametrize(("cells", "tokens"), [(1_000_000, 500_000), (7, 500_000), (7, 0)])
def test_best_overlaps(spark, monkeypatch, cells, tokens):
    monkeypatch.setattr(R, "CELLS", cells)
    monkeypatch.setattr(R, "BROADCAST_TOKENS", tokens)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, n)))
    queries = [(i, text(5)) for i in range(9)] + [(9, None), (10, ""), (11, "zz")]
    items = [((i // 3, i % 3), [text(9) for _ in range(rng.randint(0, 5))]) for i in range(60)]
    items += [((50, 0), None), ((None, 1), ["a b c d"]), ((51, 0), [None, "a b", "a b", ""]), ((52, 0), [])]
    q = spark.createDataFrame(queries, "q long, text string")
    df = spark.createDataFrame([(*ids, parts) for ids, parts in items], "a int, b long, text array<string>").repartition(3)
    got = R.best_overlaps(q, df, "q", ["a", "b"], 4, whole=True).select("q", "a", "b", "part", "overlap", "rank").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == naive_best(queries, items, 4)
    assert R.best_overlaps(q.where("false"), df, "q", ["a", "b"], 4).isEmpty() and R.best_overlaps(q, df.where("false"), "q", ["a", "b"], 4).isEmpty()


def test_vectors_meet_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(50)] + [(50, None), (51, [1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    kept = sorted(map(tuple, R.vector_topk(df, df, 4).collect()))
    monkeypatch.setattr(R, "BROADCAST_VALUES", 0)
    monkeypatch.setattr(R, "QUERY_BLOCK", 11)
    monkeypatch.setattr(R, "PACKED_ROWS", 7)
    assert len(kept) == 52 * 4 and sorted(map(tuple, R.vector_topk(df, df, 4).collect())) == kept


@pytest.mark.parametrize("bound", [0, 4_000_000])
def test_vectors_of_many_parts_hold_little(spark, monkeypatch, bound):
    """Blocks of a few vectors, parts of a few items and many ties give what all pairs give; no product
    is larger than a block."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(2)
    monkeypatch.setattr(R, "BROADCAST_VALUES", bound)
    for name, value in (("QUERY_BLOCK", 5), ("PACKED_ROWS", 7), ("ITEM_VALUES", 60)):
        monkeypatch.setattr(R, name, value)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in R.vector_topk(df.where("vec_id % 3 = 0"), df, 4).collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5 or 1.0
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / norm(a) / norm(b), 9)
    for i, a in rows[::3]:
        best = sorted((-cos(a, b), j) for j, b in rows if j != i)[:4]
        assert [got[i, k + 1] for k in range(4)] == [j for _, j in best]
    held = R.Best(np.arange(20), np.eye(20), 2)
    held.show(np.arange(20, 60), np.ones((40, 20)))
    assert held.score.shape == (20, 2) and all(b.num_rows <= 7 * 2 for b in held.batches("v"))
