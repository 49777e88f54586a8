"""Rules over nested artifacts against plain versions on Python's values."""

import copy
import datetime
import json
import random

from millrace.operators import alignment as A

CLASSES = ("external_allowed", "internal_only", "unclassified")
WRONG = [None, "", 0, 7, True, [], {}, ["x"], {"a": 1}, "2024-13-01", "2024-01-05", "unclassified", "c1"]


def whole(k):
    base = {"disclosure_class": "external_allowed", "effective_from": "2024-01-01", "effective_to": None}
    chunks = [{"chunk_id": f"c{k}-{n}", "tenant_id": "t", "shop_id": "s", "source_position": {"line": n}, **base} for n in range(3)]
    return {"document_id": f"d{k}", "tenant_id": "t", "shop_id": "s", "chunks": chunks, **base}


def harmed(rng, value):
    """One field somewhere in a value is replaced, dropped or added."""
    value = copy.deepcopy(value)
    at = value
    while True:
        key = rng.choice(list(at)) if isinstance(at, dict) else rng.randrange(len(at))
        if isinstance(at[key], (dict, list)) and at[key] and rng.random() < 0.7:
            at = at[key]
            continue
        if rng.random() < 0.25:
            del at[key]
        else:
            at[key] = copy.deepcopy(rng.choice(WRONG))
        return value


def is_day(x):
    try:
        return x is None or (isinstance(x, str) and len(x) == 10 and bool(datetime.date.fromisoformat(x)))
    except ValueError:
        return False


def policy(x, prefix):
    out = [] if isinstance(x.get("disclosure_class"), str) and x["disclosure_class"] in CLASSES else [f"{prefix}_disclosure_class_invalid"]
    since, until = x.get("effective_from"), x.get("effective_to")
    if not is_day(since) or not is_day(until):
        out.append(f"{prefix}_date_invalid")
    elif since and until and since >= until:
        out.append(f"{prefix}_date_range_invalid")
    return out


def full(x):
    return isinstance(x, str) and x != ""


def plain_corpus(lines):
    out, seen, chunk_ids = [], set(), set()
    for line, d in enumerate(lines, 1):
        if not isinstance(d, dict):
            out.append((str(line), "json_input_invalid"))
        elif not full(d.get("document_id")):
            out.append((str(line), "corpus_document_id_invalid"))
        elif d["document_id"] in seen:
            out.append((d["document_id"], "duplicate_corpus_document_id"))
        else:
            i = d["document_id"]
            seen.add(i)
            out += [(i, c) for c in ([] if full(d.get("tenant_id")) and full(d.get("shop_id")) else ["corpus_scope_invalid"]) + policy(d, "corpus_document")]
            if not isinstance(d.get("chunks"), list):
                out.append((i, "corpus_chunks_invalid"))
                continue
            for n, c in enumerate(d["chunks"], 1):
                p = f"{i}/{n}"
                if not isinstance(c, dict):
                    out.append((p, "corpus_chunk_invalid"))
                    continue
                if not full(c.get("chunk_id")):
                    out.append((p, "corpus_chunk_id_invalid"))
                elif c["chunk_id"] in chunk_ids:
                    out.append((c["chunk_id"], "duplicate_corpus_chunk_id"))
                else:
                    chunk_ids.add(c["chunk_id"])
                alike = lambda f, c=c: json.dumps(c.get(f)) == json.dumps(d.get(f))  # noqa: B023, E731
                out += [(p, "corpus_chunk_scope_mismatch")] * (not (alike("tenant_id") and alike("shop_id")))
                out += [(p, x) for x in policy(c, "corpus_chunk")]
                out += [(f"{p}/{f}", "corpus_chunk_policy_mismatch") for f in ("disclosure_class", "effective_from", "effective_to") if not alike(f)]
                if not (isinstance(c.get("source_position"), dict) and c["source_position"]):
                    out.append((p, "corpus_chunk_source_position_invalid"))
    return out


def test_rules_of_corpora(spark):
    rng = random.Random(3)
    corpora = []
    for _ in range(60):
        lines = [whole(k) for k in range(4)]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(lines))
            lines[k] = harmed(rng, lines[k]) if isinstance(lines[k], dict) and lines[k] else rng.choice(WRONG)
        lines += [copy.deepcopy(rng.choice(lines))] if rng.random() < 0.3 else []
        corpora.append(lines)
    late = {"effective_from": "2024-01-05", "effective_to": "2024-01-05"}
    odd = [whole(k) | late for k in range(3)]
    odd[0]["chunks"] = [odd[0]["chunks"][0], "x", odd[0]["chunks"][0] | late | {"disclosure_class": "x"}, {}]
    odd[1] |= {"chunks": {}, "tenant_id": 5}
    corpora.append([odd[0], odd[1], odd[2] | {"document_id": ""}, odd[1], whole(7) | {"effective_to": 3}])
    rows = [(a, n, json.dumps(d)) for a, lines in enumerate(corpora) for n, d in enumerate(lines, 1)] + [(99, 1, "no json"), (99, 2, None), (99, 3, '{"a": 1, "a": 2}')]
    got = A.corpus_issues(spark.createDataFrame(rows, "artifact_id int, line int, json string")).collect()
    expected = [(a, *i) for a, lines in enumerate(corpora) for i in plain_corpus(lines)] + [(99, str(k), "json_input_invalid") for k in (1, 2, 3)]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert len({c for _, _, c in expected}) == 17
    assert A.corpus_issues(spark.createDataFrame([], "artifact_id int, line int, json string")).count() == 0


def approved():
    checks = lambda d: [{"source_document_id": d, "evidence_chunks": [{"chunk_id": f"{d}-{n}", "source_position": {"line": n}} for n in range(2)]}]
    return {"status": "APPROVED", "source_corpus_sha256": "h", "case_to_source_documents": {c: {"x": f"d{c}"} for c in "ab"}, "case_evidence": {c: checks(f"d{c}") for c in "ab"}}


def plain_approved(a, digest, cases):
    if not isinstance(a, dict) or a.get("status") != "APPROVED" or not ("source_corpus_sha256" in a or "case_evidence" in a):
        return []
    out = [] if full(a.get("source_corpus_sha256")) and a["source_corpus_sha256"] == digest else [(None, "approved_source_corpus_sha256_mismatch")]
    evidence, mapping = a.get("case_evidence"), a.get("case_to_source_documents")
    if not isinstance(evidence, dict):
        return [*out, (None, "approved_case_evidence_missing")]
    if not isinstance(mapping, dict) or set(evidence) != set(mapping) or set(evidence) != cases:
        return [*out, (None, "approved_case_evidence_case_set_mismatch")]
    for case, checks in evidence.items():
        if not isinstance(checks, list) or not checks:
            out.append((case, "approved_case_evidence_invalid"))
            continue
        for n, check in enumerate(checks, 1):
            if not isinstance(check, dict) or not full(check.get("source_document_id")):
                out.append((f"{case}/{n}", "approved_case_evidence_check_invalid"))
                continue
            chunks = check.get("evidence_chunks")
            if not isinstance(chunks, list) or not chunks:
                out.append((f"{case}/{n}", "approved_case_evidence_chunks_missing"))
                continue
            for m, chunk in enumerate(chunks, 1):
                if not isinstance(chunk, dict) or not full(chunk.get("chunk_id")):
                    out.append((f"{case}/{n}/{m}", "approved_case_evidence_chunk_invalid"))
                if not isinstance(chunk, dict) or not isinstance(chunk.get("source_position"), dict) or not chunk["source_position"]:
                    out.append((f"{case}/{n}/{m}", "approved_case_evidence_position_invalid"))
    return out


def test_rules_of_approved_evidence(spark):
    rng = random.Random(5)
    artifacts = [approved()]
    for _ in range(150):
        a = harmed(rng, approved())
        artifacts.append(harmed(rng, a) if a and rng.random() < 0.3 else a)
    bare = approved()
    bare["case_evidence"]["a"][0]["evidence_chunks"] = []
    artifacts += [bare, {"status": "DRAFT"}, {"status": "APPROVED"}, {"status": "APPROVED", "case_evidence": {}, "case_to_source_documents": {}}, 5]
    rows = [(k, json.dumps(a), "h") for k, a in enumerate(artifacts)]
    cases = [(k, c) for k in range(len(artifacts)) for c in "ab"]
    out = A.approved_issues(spark.createDataFrame(rows, "artifact_id int, json string, corpus_sha256 string"), spark.createDataFrame(cases, "artifact_id int, case_id string"))
    expected = [(k, *i) for k, a in enumerate(artifacts) for i in plain_approved(a, "h", {"a", "b"})]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)
    assert len({c for _, _, c in expected}) == 8
