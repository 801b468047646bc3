import hashlib
import random
import re

import numpy as np
import pytest

from stockloom.llm import secretscan
from stockloom.llm.automaton import LANES, SEPARATOR, STEPS, Automaton, Rule
from tests.llm import cases

PLAIN = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    ("pem", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), bool),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), bool),
]
BITS = [
    "password", "PassWD", "secret", "token", "api_key", "APIkey", "=", ":", " ", "  ", '"', "'", "abc", "ab.c=", "x" * 7, "AKIA", "AKIA" + "Z9" * 9, "0f", "deadbeef" * 4,
    "é", "日本", "\U0001f600", "\n", "eyJ", "eyJabc.", ".", "eyJx_1.eyJy-2.z", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "ſecret", "toKen", "9" * 11, "KEY",
]


def plain(text):
    text = text or ""
    spans = [(m.start(), k, kind, m.end()) for k, (kind, rx, ok) in enumerate(PLAIN) for m in rx.finditer(text) if ok(m)]
    return [(kind, s, e) for s, _, kind, e in sorted(spans)]


def messy_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_against_plain_expressions():
    automaton = Automaton(secretscan.BASE + secretscan.FURTHER)
    texts = messy_texts(4000, 1) + ['token=token":abcdefgh', "token=abc password=longvalue", "token==a=====", "a" * 23, "a" * 24, "", "AKIA" * 5, "AKIAKIA" + "X" * 15]
    assert sum(map(len, map(plain, texts))) > 3000
    assert secretscan.found(automaton, [t.encode() for t in texts]) == [plain(t) for t in texts]


def test_long_texts_cross_lanes_and_blocks():
    automaton = Automaton(secretscan.BASE + secretscan.FURTHER)
    block = STEPS * LANES
    texts = ["0" * (block + 5000), " " * (block - 4) + "token = " + "v" * 3000 + " ", "x".join(messy_texts(5000, 2)), "password:" + "é" + "a" * 30]
    assert secretscan.found(automaton, [t.encode() for t in texts]) == [plain(t) for t in texts]


def test_minimal_and_refused_rules():
    assert Automaton([Rule("a", "ab|ac")]).states == Automaton([Rule("a", "a[bc]")]).states
    with pytest.raises(ValueError):
        Automaton([Rule("a", "ab(cd)?")])  # after "abc" the match "ab" would have to be given back
    with pytest.raises(ValueError):
        Automaton([Rule("a", "a*")])
    with pytest.raises(ValueError):
        Automaton([Rule("a", "abcde|c")])
    with pytest.raises(ValueError):
        Automaton([Rule("a", "(ab")])
    one = Automaton([Rule("a", "(?:ab){2,3}c+", least=2), Rule("b", r"\x41[x-z\]]?B", fold=True)])
    text = b"ababababccc ababc aB aXb a]b " + bytes([SEPARATOR])
    got = {(one.rules[r].kind, text[s:e]) for r, s, e in one.matches(np.frombuffer(text, np.uint8))}
    assert got == {("a", b"abababccc"), ("b", b"aB"), ("b", b"aXb"), ("b", b"a]b")} | {("b", x) for x in (b"ab",)}


def test_query_rows(spark, tmp_path):
    texts = cases.awkward() + messy_texts(200, 3)
    cases.messy(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, secretscan.op11_secret_automaton(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in [*enumerate(texts), (6, texts[6]), (None, texts[6])]:
        spans = plain(t)
        n = lambda kind, s=spans: sum(k == kind for k, _, _ in s)
        show = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        base = show([x for x in spans if x[0] in ("assign", "access", "hex")])
        want.append((i, n("assign"), n("access"), n("hex"), hashlib.sha256(base.encode()).hexdigest(), show(spans)))
    assert got == sorted(want, key=str)


def test_sql_agrees(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    cases.docs(spark, cases.awkward() + messy_texts(300, 4)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = secretscan.op11_secret_automaton(spark, str(tmp_path))
    want = duckdb.sql(secretscan.SQL)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_empty_table(spark, tmp_path):
    cases.docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert secretscan.op11_secret_automaton(spark, str(tmp_path)).collect() == []
