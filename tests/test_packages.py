"""Chunks of elements, dataset hashes and the gate of packages against plain versions."""

import hashlib
import json
import random

import pytest

from millrace.operators import packages as P
from test_evidence import pieces

KINDS = ("text", "heading", "row", "list", "quote", "table")


def plain_chunks(elements, size, overlap):
    """What the rules give, element by element."""
    out, section = [], 0
    for doc, _, kind, text, first, last in elements:
        if not text:
            continue
        section += 1
        for k, (a, b, why) in enumerate(pieces(text, size)):
            start = max(0, a - overlap) if k else a
            shown = "table" if kind == "row" else kind
            if why == "element_boundary" and shown in P.CONTENT_TYPES:
                why = f"{shown}_boundary"
            content_type = kind if kind in P.CONTENT_TYPES else "text"
            place = {"first_line": first, "last_line": last, "char_start": start, "char_end": b}
            whole = {"document_id": doc, "version_id": "v", "source_position": place, "content": text[start:b], "content_type": content_type, "rule_version": "structured-v2"}
            digest = hashlib.sha256(json.dumps(whole, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
            out.append((doc, "chunk-" + digest[:20], section, k, start, b, text[start:b], content_type, why, digest))
    return out


@pytest.mark.parametrize("overlap", [0, 15])
def test_chunks_of_elements(spark, overlap):
    rng = random.Random(8)
    parts = ["ab ", "x. ", "长句。", 'quote " and \\ ', "\ttab\n", "é/", "没" * 60]
    elements = [("d", i, rng.choice(KINDS), "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), i, rng.choice([None, i + 2])) for i in range(25)]
    elements.append(("d", 25, "text", None, 1, 1))
    df = spark.createDataFrame(elements, "document_id string, element_index int, kind string, text string, first_line int, last_line int").selectExpr("*", "'v' AS version_id")
    got = [tuple(r) for r in P.element_chunks(df, 50, overlap).drop("version_id").orderBy("section_seq", "section_chunk_index").collect()]
    assert got == plain_chunks(elements, 50, overlap)
    assert P.element_chunks(df.where("false")).isEmpty()
    with pytest.raises(ValueError, match="overlap"):
        P.element_chunks(df, 50, 50)


def test_dataset_hash(spark):
    docs = [(1, 1, "b", "h2", 3), (1, 0, "a", "h1", 0)]
    docs = spark.createDataFrame(docs, "package_id int, position int, document_id string, source_hash string, chunks long")
    got = dict(map(tuple, P.dataset_hashes(spark.createDataFrame([(1, "m"), (2, None)], "package_id int, manifest_sha256 string"), docs).collect()))
    rows = [{"document_id": "a", "source_hash": "h1", "chunks": 0}, {"document_id": "b", "source_hash": "h2", "chunks": 3}]
    digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert got == {1: digest({"manifest_sha256": "m", "documents": rows}), 2: digest({"manifest_sha256": None, "documents": []})}
