"""Secret scanning with one automaton for all rules.

The texts of a batch are joined by a byte that no UTF-8 text holds and scanned in one pass (see
`automaton`); each task scans the split it reads, so nothing is shuffled. A scan holds the batch and
a few bytes for each byte of a block, however long a text is, and takes time in proportion to the bytes.

A null text is empty and has no secret. Null and repeated doc_ids are documents
like others; each row gives a row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.llm.automaton import SEPARATOR, Automaton, Rule
from stockloom.llm.common import small_text_batches, text_bytes

# --- Fixed values: rules that every scan has --------------------------------
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", least=6, fold=True),
    # a run that is too short holds no longer one, so the least length can be part of the expression
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
]
# --- Fixed values: further formats ------------------------------------------
FURTHER = [
    Rule("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+"),
]
SPANS = "array<struct<kind: string, start: long, end: long>>"


def code_points(data: np.ndarray, offsets: list[int]) -> list[int]:
    """Code points before each of the ascending byte offsets of a text."""
    out, at, count = [], 0, 0
    for o in offsets:
        count += int(np.count_nonzero((data[at:o] & 0xC0) != 0x80))
        at = o
        out.append(count)
    return out


def found(automaton: Automaton, texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in code points for each text, by start, then the rules' order."""
    data = np.frombuffer(b"".join(x for t in texts for x in (t, bytes([SEPARATOR]))), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for r, start, end in automaton.matches(data):
        spans[int(np.searchsorted(ends, start, side="right"))].append((start, r, end))
    out = []
    for i, own in enumerate(spans):
        first = int(ends[i]) - len(texts[i]) - 1
        places = sorted({x for s, _, e in own for x in (s, e)})
        point = dict(zip(places, code_points(data[first : int(ends[i])], [x - first for x in places])))
        out.append([(automaton.rules[r].kind, point[s], point[e]) for s, r, e in sorted(own)])
    return out


def secrets(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, spans): the secrets of each whole text, as code point ranges."""
    small_text_batches(docs.sparkSession)
    automaton = Automaton(BASE + FURTHER if rules is None else rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            rows = [[{"kind": k, "start": s, "end": e} for k, s, e in own] for own in found(automaton, list(text_bytes(b.column(1))))]
            yield pa.record_batch([b.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op11_secret_automaton(spark, sf_dir: str) -> DataFrame:
    """Contract query: counts and digest of the base spans, and all spans."""
    base = [r.kind for r in BASE]
    all_spans = secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return all_spans.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("spans", lambda s: s.kind.isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def _starts(kind: str, rank: int, expression: str, keep: str = "TRUE") -> str:
    """Spans of one expression: lengths of the texts between its matches give the places."""
    return f"""SELECT row, '{kind}' AS kind, {rank} AS rank, place - length(hit) AS s, place AS e FROM (
      SELECT row, hit, SUM(length(hit) + length(gap)) OVER (PARTITION BY row ORDER BY i) AS place FROM (
        SELECT row, UNNEST(hits) AS hit, UNNEST(gaps[:len(hits)]) AS gap, UNNEST(range(len(hits))) AS i FROM (
          SELECT row, regexp_extract_all(t, '{expression}') AS hits, string_split_regex(t, '{expression}') AS gaps FROM docs))) WHERE {keep}"""


def _any_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_KEYWORD = _any_case("(password|passwd|secret|token|api_?key)").replace("(", "(?:") + """["'']?\\x20*[:=]\\x20*["'']?"""
SQL = f"""WITH docs AS (SELECT row_number() OVER () AS row, doc_id, COALESCE(text, '') AS t FROM documents),
found AS ({_starts("assign", 1, _KEYWORD + "[A-Za-z0-9+/_.=-]+", f"length(regexp_replace(hit, '^{_KEYWORD}', '')) >= 6")}
  UNION ALL {_starts("access", 2, "AKIA[A-Z0-9]+", "length(hit) >= 20")}
  UNION ALL {_starts("hex", 3, "[0-9a-f]{24,}")}
  UNION ALL {_starts("pem", 4, "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")}
  UNION ALL {_starts("jwt", 5, "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+")}),
named AS (SELECT row, rank, s, kind || ':' || s || ':' || e AS span FROM (SELECT row, kind, rank, CAST(s AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM found))
SELECT d.doc_id, COUNT(*) FILTER (rank = 1) AS n_assign, COUNT(*) FILTER (rank = 2) AS n_access, COUNT(*) FILTER (rank = 3) AS n_hex,
  sha256(COALESCE(string_agg(span, ',' ORDER BY s, rank) FILTER (rank <= 3), '')) AS base_sha256, COALESCE(string_agg(span, ',' ORDER BY s, rank), '') AS spans
FROM docs d LEFT JOIN named n USING (row) GROUP BY row, d.doc_id"""
