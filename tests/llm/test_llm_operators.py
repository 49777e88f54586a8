"""Each operator against a plain version of its contract, and on odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import fingerprints, html_text, mixing, pieces, quality, sharding, token_files, toxicity

ODD = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, "word"), (5, "word"), (6, "a b c d e f g " * 400), (7, "Ünï   çödé " * 20), (8, "x" * 5000)]
SPACE = b" \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().split()


def repeated_words(w):
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)})


def test_quality_counts(docs):
    rng = random.Random(5)
    rows = ODD + [(100 + i, " ".join(rng.choice(["a", "bb", "#c", "d\n", "\n"]) for _ in range(rng.randint(0, 80)))) for i in range(60)]
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge_quality(docs(rows)).collect())
    expected = []
    for i, t in rows:
        w, t = words(t), t or ""
        lines = [x for x in t.split("\n") if x.encode().strip(SPACE)]
        n = repeated_words(w)
        expected.append((str(i), len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n, len(w) < 10 or 100 * n > 20 * len(w)))
    assert got == sorted(expected)


def test_quality_order_changes_no_verdict(docs):
    rows = [(i, " ".join(["#x"] * (i % 7) + [f"word{k}Thing" for k in range(3 * (i % 11))])) for i in range(200)]
    rules = quality.default_rules()
    a = {r["doc_id"]: r["kept"] for r in quality.judge_quality(docs(rows), rules).collect()}
    b = {r["doc_id"]: r["kept"] for r in quality.judge_quality(docs(rows), rules[::-1], sample_rows=1).collect()}
    assert a == b and len(set(a.values())) == 2


def test_costly_rules_and_those_with_nothing_left_go_last(docs):
    df = quality.text_statistics(docs([(i, f"{'#x ' * (i % 2)} word{i}") for i in range(300)]))
    odd, every = F.col("doc_id") % 2 == 1, F.col("doc_id") % 3 > 0
    rules = [
        quality.Rule("costly", every, F.lit(5000)),
        quality.Rule("same", odd, F.lit(11)),
        quality.Rule("cheap", odd, F.lit(10)),
        quality.Rule("rare", F.col("doc_id") == 2, F.lit(10)),
        quality.Rule("null", F.lit(None).cast("boolean"), F.lit(10)),
    ]
    names = [r.name for r in quality.order_rules(df, rules)]
    assert names[:2] == ["cheap", "rare"] and names[-1] == "costly"
    assert names == [r.name for r in quality.order_rules(df.repartition(3), rules)]


def test_odd_tables_of_quality(spark, docs):
    assert quality.judge_quality(docs([])).count() == 0
    df = spark.createDataFrame([(None, None, 1, "x"), (3, "one two", 2, "y")], "doc_id long, text string, w int, h string")
    assert [r["n_words"] for r in quality.judge_quality(df).orderBy("doc_id").collect()] == [0, 2]


def test_mix_reaches_targets(docs):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 400)))) for i in range(500)] + ODD
    got = mixing.mix(docs(rows)).taken().collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in got)
    targets = {s: x[0]["target"] for s, x in by.items()}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    for s, x in by.items():
        size = sum(r["size"] for r in x)
        assert x[0]["source_size"] == size and targets[s] <= 2 * size + 1e-6
        assert abs(sum(r["taken"] for r in x) - targets[s]) <= 1
    again = mixing.mix(docs(rows[::-1]).repartition(7)).taken().collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_every_source_gets_its_slots_and_every_prefix_is_mixed(spark):
    rng = random.Random(61)
    rows = [(i, "w " * rng.randint(1, 60), f"s{min(int(rng.expovariate(0.5)), 9)}") for i in range(1500)] + [(5000, "w w w", "tiny")]
    plan = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=32)
    sources = {r["sid"]: r for r in plan.sources.collect()}
    schedule = [r.asDict() for r in plan.schedule.orderBy("slot").collect()]
    taken = {sid: 0 for sid in sources}
    total = sum(r["want"] for r in sources.values())
    for n, slot in enumerate(schedule, 1):
        taken[slot["sid"]] += slot["take"]
        done = sum(taken.values())
        if n % 50 == 0 and n < len(schedule) * 0.95:
            # Blocks of a source are equal; few are ahead of or behind their share at any time.
            assert all(abs(taken[s] - done * r["want"] / total) <= 6 * 64 for s, r in sources.items())
    assert all(taken[s] == r["want"] for s, r in sources.items())
    picks = plan.taken().collect()
    assert all((r["first_slot"] is None) == (r["taken"] == 0) for r in picks)


def test_mixed_texts_keep_their_lines_and_columns_their_values(spark):
    rows = [(i, f"one {i}\n\ttwo  three\nfour {i} ", "a" if i % 3 else "b", i, f"k{i}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _n int, text_key string, pick_id int")
    out = mixing.mixed_documents(df, slot_col="slot", block_words=4).collect()
    texts = {r[0]: r for r in rows}
    assert out and any(r["text"] != texts[r["doc_id"]][1] for r in out)
    for r in out:
        assert texts[r["doc_id"]][1].startswith(r["text"]) and (r["_n"], r["text_key"], r["pick_id"]) == texts[r["doc_id"]][3:]
    assert all(r["slot"] >= 0 for r in out)


def test_mixed_documents_have_the_words_that_were_taken(docs):
    rows = [(i, " ".join(f"w{i}" for _ in range(50 + i))) for i in range(60)]
    df = docs(rows)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(df).taken().collect()}
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    found = {}
    for r in out.collect():
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    assert found == {i: n for i, n in taken.items() if n}


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [*ODD, (9, "it's ROCK'n'roll, İstanbul ΣΑΣ é x²½ don't_12"), (10, "Plain words, again. Plain"), (-3, "first")]
    place, order = token_files.write_token_files(docs(rows), path, end_id=2)
    got = [tuple(r) for r in token_files.read_token_files(spark, place, order).collect()]
    tokenizer = Tokenizer.from_file(path)
    expected, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_word_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(17)
    parts = ["<|EndOfText|>", "<|endoftext|>", "<|STARTOFTEXT|>", "<|", "word", "Word,", "it's", "'S", "x²", "a_b", "don't.", "...", "é%%%,", "12", "3.5", "ª", "'ſ", ",'s", "—", "\u3000", "\x85", "i\u0307", "ÇA"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n", "\t "]) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    texts += ["<|EndOfText|> x", "a <|ENDOFTEXT|>", "x<|StartOfText|>y"]
    got = [np.frombuffer(x, "<u2").tolist() for x in token_files.WordIds(path, 2)(texts)]
    library = Tokenizer.from_file(path)
    assert got == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_other_tokenizer_files_go_to_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.loads(open(public_tokenizers.path("word_bpe_49k.json")).read())
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]
    path = str(tmp_path / "cased.json")
    open(path, "w").write(json.dumps(spec))
    found = token_files.WordIds(path, 2)
    assert found.piece is None
    texts = ["Plain Words, again", "", "ÉTÉ"]
    library = Tokenizer.from_file(path)
    assert [np.frombuffer(x, "<u2").tolist() for x in found(texts)] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_token_files_of_an_empty_table(spark, docs):
    place, order = token_files.write_token_files(docs([]), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    assert token_files.read_token_files(spark, place, order).count() == 0


def test_byte_coding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        assert token_files.decode_values(*token_files.encode_values(v), n).tolist() == v.tolist()


def test_shards_of_a_group_above_a_share_are_even(docs):
    for rows in ([(7, "same " * 40)] * 300, [(None, "same " * 40)] * 300):
        rows = rows + [(1000 + i, f"{i:03} " * 50) for i in range(300)]
        got = sharding.assign_shards(docs(rows), shards=10).collect()
        sums = Counter()
        for r in got:
            sums[r["shard"]] += r["size"]
        assert len(sums) == 10 and max(sums.values()) <= 1.25 * sum(sums.values()) / 10
        assert sum(r["group_cut"] for r in got) == 300
        by = {}
        for r in got:
            by.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shard_digests_and_odd_tables(docs):
    got = sharding.assign_shards(docs(ODD), shards=3).collect()
    expected = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ODD)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == expected
    assert sharding.assign_shards(docs([]), shards=3).count() == 0


def test_pack_puts_large_items_apart():
    assert Counter(sharding.pack([1000, 10, 10, 10, 10], 3)).most_common()[0][1] == 2
    assert sorted(Counter(sharding.pack([5] * 40, 8)).values()) == [5] * 8
    assert sharding.pack([], 4) == [] and sharding.pack([3], 1) == [0]


def test_shards(docs):
    rng = random.Random(7)
    rows = ODD + [(1000 + i, "t" * rng.randint(0, 3000)) for i in range(800)] + [(5000 + i, "same text") for i in range(40)]
    got = sharding.assign_shards(docs(rows), shards=8).collect()
    assert len(got) == len(rows)
    sizes, slots, where = {}, {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert max(sizes.values()) <= 1.02 * sum(sizes.values()) / 8 + 6000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for r in got:
        if r["doc_id"] and r["doc_id"] >= 5000:
            where.setdefault(r["shard"], 0)
    assert len(where) == 1


def test_best_fit():
    assert sharding.best_fit_decreasing([5, 4, 3, 2, 1], 5) == [0, 1, 2, 2, 1]
    assert sharding.best_fit_decreasing([9], 5) == [0]
    assert sharding.pack([], 3) == []


def test_fold_undoes_disguises():
    folded = toxicity.fold("You 1D10T, pаthеtic m0r0n! l​oser").split()
    assert folded == ["you", "idiot", "pathetic", "moron", "loser"]


def test_toxicity_learns_and_leaves_exceptions(spark, docs):
    rng = random.Random(8)
    plain = lambda: [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(20, 120))]
    rows, labels = [], []
    for i in range(1500):
        w, bad = plain(), i % 5 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["badword", "nastything", "uglyone", "zzstem" + rng.choice("abcdef")]))
        elif i % 7 == 0:
            w += ["badword", "free"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    df, known = docs(rows), spark.createDataFrame([*labels, (None, 1), (99_999, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(df, known)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(df, lexicon).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    out = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert sum(p == y for p, y in out) >= 0.97 * len(out)
    odd = toxicity.score_toxicity(docs([*ODD, (77, "BADWORD! b@dword nastything " * 3)]), lexicon).collect()
    assert len(odd) == len(ODD) + 1 and [r["doc_id"] for r in odd if r["predicted"]] == [77]
    assert toxicity.reject_toxic(docs([*ODD, (77, "badword nastything uglyone")]), lexicon).count() == len(ODD)
    assert toxicity.score_toxicity(docs([]), lexicon).count() == 0


def test_toxicity_without_labels(spark, docs):
    lexicon = toxicity.learn(docs(ODD), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score_toxicity(docs(ODD), lexicon).collect()} == {0}


def chained(parts):
    h = 42
    for w in parts:
        h = xxhash.xxh64_intdigest(w, h)
    return h - (1 << 64) if h >> 63 else h


def sketch(text):
    w = words(text)
    h = {chained(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    kept = sorted(x for x in h if x < -(1 << 63) + (1 << 61))
    return kept or sorted(h)[:1]


def test_fingerprints(docs):
    rng = random.Random(9)
    rows = ODD + [(10 + i, " ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(rng.randint(0, 200)))) for i in range(1400)]
    line = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    expected = []
    for k, (i, t) in enumerate(line):
        after = line[(k + 1) % len(line)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = sketch(t), sketch(edited), sketch(after)
        like = lambda x, y: len({*x} & {*y}) / len({*x} | {*y}) if x or y else 1.0
        name = "".join(f"{x + (1 << 63):016x}" for x in a)
        expected.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), name, round(like(a, b), 9), round(like(a, c), 9)))
    got = fingerprints.fingerprint_documents(docs(rows).repartition(5))
    got = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got.collect()]
    assert sorted(got) == sorted(expected)
    assert fingerprints.fingerprint_documents(docs([])).count() == 0
    one = fingerprints.fingerprint_documents(docs([(3, "only one text here")])).first()
    assert one["near_next"] == 1.0


def test_containment_of_unequal_texts(spark):
    long, short = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(long, short)], "a string, b string")
    df = fingerprints.with_sketch(fingerprints.with_sketch(df, "a", "x"), "b", "y")
    r = df.select(fingerprints.containment(F.col("y"), F.col("x")).alias("c"), fingerprints.likeness(F.col("x"), F.col("y")).alias("l")).first()
    assert r["c"] == 1.0 and 0.05 < r["l"] < 0.2


PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>'
    '<nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies<div>ok</div></div><div class="ad">Buy</div><article class="post"><h1>Ti&amp;tle</h1>'
    "<p>One &lt;two&gt;<br>three\n  <b>four</b>.<p>Five &eacute;&#x41;<form><input><p>mail</form><ul><li>item</ul><aside>side</aside>"
    '<section id="comments"><article>me too</article></section><p>A > B &am</article><footer>&copy; x</footer></body></html>'
)


def test_html_blocks():
    plain = lambda *texts: [(t, False) for t in texts]
    assert html_text.read_blocks(PAGE) == plain("Ti&tle", "One <two> three four.", "Five éA", "item", "A > B &am")
    assert html_text.read_blocks("") == []
    assert html_text.read_blocks("plain <b>text") == [("plain text", True)]
    assert html_text.read_blocks("<div class='main'><p>a<p hidden>b</p><p style='display: none'>c</p></div>") == [("a", True)]
    hinted = "<article><p>a</p><div class='share-price'><div>b</div>c</div><p class='form-row'>d</p><div class='x share'>e</div>f</article>"
    assert html_text.read_blocks(hinted) == [("a", False), ("b", True), ("c", True), ("d", True), ("f", False)]


def test_values_and_longer_names_of_attributes_rule_nothing_out():
    kept = ["<p title='hidden treasure'>", '<a title="hidden lake">', "<p data-id=share>", '<section data-role="banner">', "<p data-hidden>", "<p alt='class=ad' id=x>", '<p data-x="a\'b" title=" role=menu ">']
    page = "<article>" + "".join(f"{tag}text {i}</{tag[1:].split()[0].rstrip('>')}>\n" for i, tag in enumerate(kept)) + "</article>"
    assert " ".join(t for t, _ in html_text.read_blocks(page)).split() == [x for i in range(len(kept)) for x in ("text", str(i))]
    assert not any(hinted for _, hinted in html_text.read_blocks(page))


def test_widget_names_on_an_articles_paragraphs_only_hint(spark):
    """Differencing keeps what this page alone says and drops what the next page says too."""
    part = lambda own: f"<article><p>own {own}</p><p class='search'>searched {own}</p><p id='notice'>noted {own}</p><p class=share>send this on</p><p class=ad>buy {own}</p></article>"
    assert html_text.read_blocks(part(1)) == [("own 1", False), ("searched 1", True), ("noted 1", True), ("send this on", True)]
    rows = [(i, f"http://h/a/{i}", part(i)) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own {i}\n\nsearched {i}\n\nnoted {i}" for i in range(3)}


def test_hints_are_settled_by_the_nearest_page(spark):
    page = lambda i: f"<body><div>Menu</div><article><p>The same quote.</p><p>Own {i}</p><div class='share-price'>Price {i}</div><div class='share-row'>Share this</div></article></body>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(10, 20)]
    # Copies at other paths are no neighbours: the next page beyond them is.
    rows += [(30 + k, f"https://c.example/a{k}", "<p>Menu</p><p>Text a</p>") for k in range(4)] + [(40, "https://c.example/b", "<p>Menu</p><p>Text b</p>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"The same quote.\n\nOwn {i}\n\nPrice {i}" for i in range(10, 20))
    assert all(got[30 + k] == "Text a" for k in range(4)) and got[40] == "Text b"


def test_html_of_empty_tables_and_long_pages(spark):
    schema = "page_id long, url string, html string, _host int, shared string"
    assert html_text.extract_text(spark.createDataFrame([], schema)).count() == 0
    long = "<article>" + "<p>" + "</p><p>".join(f"word{i} and more" for i in range(30_000)) + "</p></article>"
    out = html_text.extract_text(spark.createDataFrame([(1, "u", long, 5, "x")], schema)).collect()
    assert out[0]["text"].count("\n\n") == 29_999


def test_every_line_is_differenced_before_markup_checks(spark):
    """Menus, adverts and footers that differ from page to page are told by where pages differ most."""
    page = lambda i: (
        f"<head><title>t</title></head><body><nav><ul><li>Home<li>menu {i}</ul></nav><div class=ad{i}>advert {i}</div>"
        f"<article><h1>Own title {i}</h1><p>The same quote.</p><p>A long passage of page {i} that no other has</p></article><footer>foot {i}</footer></body>"
    )
    places = [(text, place) for text, place, _ in html_text.read_lines(page(1))]
    assert places[:3] == [("Home", "nav/ul/"), ("menu 1", "nav/ul/"), ("advert 1", "div.ad#/")] and places[-1] == ("foot 1", "footer/")
    rows = [(i, f"http://h/a/{i}", page(i)) for i in range(5)] + [(9, "http://lone/", page(9))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: [(x["text"], x["shared"], x["inside"]) for x in r["lines"]] for r in html_text.difference_pages(frame).collect()}
    for i in range(5):
        assert [t for t, shared, inside in got[i] if inside and not shared] == [f"Own title {i}", f"A long passage of page {i} that no other has"]
        assert [t for t, shared, inside in got[i] if inside and shared] == ["The same quote."] and len(got[i]) == 7
    assert {inside for _, _, inside in got[9]} == {None}
    text = {r["page_id"]: r["text"] for r in html_text.extract_text(frame).collect()}
    assert all(text[i] == f"Own title {i}\n\nThe same quote.\n\nA long passage of page {i} that no other has" for i in text)


def test_differencing_rules_out_hinted_widgets_of_pages_without_article(spark):
    page = lambda i: f"<div class=story><p>A long passage {i} of the story</p><p class=form-row>row {i}</p></div><div class=ad-slot><p>buy {i}</p></div><div class=tail><p>end {i}</p></div>"
    rows = [(i, f"http://h/a/{i}", page(i)) for i in range(4)] + [(7, "http://h/b", "<div class=menu-card><p>Another kind of page</p></div>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"A long passage {i} of the story\n\nrow {i}\n\nend {i}" for i in range(4)) and got[7] == "Another kind of page"


def test_many_copies_are_dealt_into_slots(spark, monkeypatch):
    monkeypatch.setattr(html_text, "SLOT_ROWS", 3)
    rows = [(i, f"http://h/{i}", "<p>Menu</p><p>same</p>") for i in range(20)] + [(30, "http://h/x", "<p>Menu</p><p>other</p>")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == [(i, "same") for i in range(20)] + [(30, "other")]


def test_long_alignments_hold_few_rows():
    rng = random.Random(4)
    for n, kinds in ((300, 3), (5000, 5000), (4500, 40)):
        a, b = ([rng.randrange(kinds) for _ in range(n)] for _ in range(2))
        at, it = html_text.common_lines(a, b), iter(b)
        assert all(a[i] in it for i in at) and (n > 300 or len(at) == lcs(a, b))
        assert len(html_text.common_lines(b, a)) == len(at)


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(10)
    for _ in range(300):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 25))] for _ in range(2))
        at = html_text.common_lines(a, b)
        assert len(at) == lcs(a, b) and at == sorted(set(at))
        it = iter(b)
        assert all(a[i] in it for i in at)


def test_pages_lose_what_their_neighbour_has(spark):
    rows = [(i, f"https://h.example/p/{i:03}", f"<body><p>Menu</p><div>Header line</div><p>Own text {i}</p><p>End</p></body>") for i in range(30)]
    rows += [(100, "https://alone.example/x", "<p>Menu</p><p>Kept</p>"), (101, None, None), (102, "https://h.example/p/art", PAGE), (None, "bad", ""), (5, rows[5][1], rows[5][2])]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[i] == f"Own text {i}" for i in range(30))
    assert text[100] == "Menu\n\nKept" and text[101] == "" and text[102].startswith("Ti&tle")
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def best_path(unit, scores, unknown):
    """The best sum by trying every cut."""
    best = [0.0] + [None] * len(unit)
    for e in range(1, len(unit) + 1):
        for s in range(e):
            if best[s] is None:
                continue
            w = scores.get(unit[s:e])
            if w is None and e == s + 1:
                w = unknown
            if w is not None and (best[e] is None or best[s] + w > best[e]):
                best[e] = best[s] + w
    return best[-1]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))


def test_pieces_take_the_best_path(codec):
    rng = random.Random(11)
    texts = pieces.trie_texts(codec.pieces)
    scores = {t.replace(pieces.MARK, " "): codec.pieces.scores[i] for t, i in texts.items()}
    for _ in range(400):
        unit = " " * rng.randint(0, 3) + "".join(rng.choice("etaoinshrdluABC,.é€漢𝕏") for _ in range(rng.randint(1, 14)))
        ids = codec.path(unit)
        total = sum(codec.pieces.scores[i] for i in ids if codec.pieces.kinds[i] != 6)
        byte_run = b"".join(codec.surface[i] for i in ids if codec.pieces.kinds[i] == 6)
        total += codec.unknown * len(byte_run.decode())
        assert total == pytest.approx(best_path(unit, scores, codec.unknown), rel=1e-12)


def test_pieces_are_no_worse_than_the_library_as_a_unigram_model(spark, small, codec):
    """The same model file, read as a unigram model (field 2.3 of the file): nearly all words have
    the same ids, and where they differ the sum of scores here is the larger one."""
    import sentencepiece

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        data = f.read()
    spec = next(v for n, v in pieces.fields(data) if n == 2)
    changed = spec.replace(b"\x18\x02", b"\x18\x01", 1)
    assert changed != spec
    library = sentencepiece.SentencePieceProcessor(model_proto=data.replace(spec, changed, 1))
    text = spark.read.parquet(f"{small}/documents.parquet").select("text")
    unique = sorted({w for r in text.collect() for w in r["text"].split()})
    other, score = 0, lambda ids: sum(codec.pieces.scores[i] for i in ids)
    for w, theirs in zip(unique, library.encode(unique), strict=True):
        own = np.frombuffer(codec.encode(w), codec.kind).tolist()
        if own != theirs:
            other += 1
            assert score(own) >= score(theirs)
    assert other <= 0.01 * len(unique)


def test_pieces_round_trip(docs, codec):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [*ODD, (9, " lead  and trail  "), (10, "▁ marks ▁▁"), (11, "tabs\tand\x00bytes ퟿ 𝕏 ​"), (12, "\n\nlines\n"), (13, "<s> </s> <0x41> <unk>")]
    out = pieces.encode_documents(docs(rows), path).collect()
    assert sorted(map(str, ((r["doc_id"], r["decoded"]) for r in out))) == sorted(map(str, ((i, t or "") for i, t in rows)))
    digests = pieces.piece_digests(docs(rows), path).collect()
    assert all(r["round_trip"] for r in digests) and len(digests) == len(rows)
    assert {r["n_tokens"] for r in digests if r["doc_id"] == 2} == {0}
    assert pieces.encode_documents(docs([]), path).count() == 0


def test_shards_don_t_depend_on_partitions(docs):
    rng = random.Random(23)
    rows = [(i, "x" * rng.randint(0, 300)) for i in range(300)] + [(1000 + i, "one large group of equal texts " * 4) for i in range(400)] + [(7, "again")] * 60 + [(None, None)] * 5
    runs = []
    for n in (1, 7):
        out = sharding.assign_shards(docs(rng.sample(rows, len(rows))).repartition(n), shards=8).collect()
        runs.append(sorted((tuple(r) for r in out), key=str))
    assert runs[0] == runs[1]
    assert len({r[3] for r in runs[0] if r[5]}) > 1


def test_features_are_those_of_a_naive_search():
    """Weights, lengths, frequent terms and phrases of exceptions, found position by position."""
    rng = random.Random(24)
    terms = {" bad ": 0.7, " ugly": 0.4, " bad" + toxicity.OFTEN: 0.2, " ugly" + toxicity.OFTEN: 0.9, " b": 0.1, " bad": 0.3, " badger ": 1.1}
    lexicon = toxicity.Lexicon(terms, (" not bad ", " bad ugly duck "))
    automaton = lexicon.automaton()
    for _ in range(300):
        text = " ".join(rng.choice(["bad", "badger", "ugly", "uglyone", "not", "duck", "fine", "b", "x"]) for _ in range(rng.randint(0, 60)))
        folded = toxicity.fold(text)
        shielded = [(i, i + len(p)) for p in lexicon.exceptions for i in range(len(folded)) if folded.startswith(p, i)]
        n_words, total, every = len(folded.split()), 0.0, 0.0
        for term in {t.removesuffix(toxicity.OFTEN) for t in terms}:
            at = [i for i in range(len(folded)) if folded.startswith(term, i) and not any(a <= i and i + len(term) <= b for a, b in shielded)]
            if at:
                often = terms.get(term + toxicity.OFTEN, 0.0) if toxicity.frequent(len(at), n_words) else 0.0
                w = terms.get(term, 0.0) + often
                total += w
                every += len(at) * w
        got = toxicity.features(text, automaton)
        assert np.allclose(got, (np.log1p(total), np.log1p(1000 * every / (n_words + 20))))
