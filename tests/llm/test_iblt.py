import hashlib
import random
import re

import pytest

from stockloom.llm import iblt
from tests.llm import cases


def units(text):
    return set(re.findall(r"[^\n]{200,}?[.!?](?=[ \n]|$)|[^\n]+", text))


def likeness(a, b):
    a, b = units(a), units(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


def check(spark, rows):
    """rows: (doc_id, text), distinct ids."""
    frame = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, block string, top string")
    got = {r.doc_id: r for r in iblt.edit_report(frame).collect()}
    order = sorted(((d, t or "") for d, t in rows), reverse=True)
    assert len(got) == len(rows)
    for (d, t), (_, f) in zip(order, order[1:] + order[:1]):
        n = len(t) // 2
        edited = t[: len(t) - n] + f[:n]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(likeness(t, edited)) and r.near_next == pytest.approx(likeness(t, f)), (t, f)
        assert (r.fingerprint == r.edited_fingerprint) == (units(t) == units(edited))
    by_text = {}
    for d, t in order:
        assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint


def prose(rng, lines):
    return "\n".join(" ".join("".join(rng.choice("abcdefg") for _ in range(4)) + rng.choice(["", "", "."]) for _ in range(rng.randint(1, 90))) for _ in range(lines))


def test_against_brute_force(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([1, 2, 5, 20, 60])) for _ in range(60)]
    texts += [t for t in cases.awkward()] + [texts[0], texts[0], texts[1] + "\n" + texts[2], None, "", "x\ny", "\U0001f600\n\U0001f601b"]
    check(spark, [(i * 97 - 2000, t) for i, t in enumerate(texts)])  # many blocks, gaps, negative ids


def test_one_block_and_one_document(spark):
    check(spark, [(i, f"line {i}\nshared") for i in range(20)])
    check(spark, [(7, "only\none here")])


def test_parts_and_retries(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(iblt, "PART", 30)
    check(spark, [(i, prose(rng, 80)) for i in range(6)])
    monkeypatch.setattr(iblt, "RETRIES", 0)  # what cannot be peeled is compared directly
    check(spark, [(i, prose(rng, 40)) for i in range(6)])


def test_null_ids_repeats_and_empty(spark):
    texts = cases.awkward()[:9]
    got = iblt.edit_report(cases.messy(spark, texts)).collect()
    assert len(got) == len(texts) + 2
    lone = next(r for r in got if r.doc_id is None)
    assert lone.near_next == 1.0 and len({r.fingerprint for r in got if r.doc_id in (6, None)}) == 1
    assert iblt.edit_report(cases.docs(spark, [])).count() == 0


def test_native_plan(spark):
    plan = iblt.edit_report(cases.docs(spark, ["a"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
