"""Document fingerprints as invertible Bloom lookup tables of paragraph digests, in SQL functions only.

A text's paragraphs (lines; a line of over 200 characters is taken in parts that end with a
sentence) are hashed; their distinct digests are a set. The table has three
ranges of cells; a digest is added to one cell of each: a count, an exclusive or
of digests, and one of their check hashes. Tables of two texts subtract cell by
cell, what both hold vanishes, and peeling recovers the rest: a cell with count
1 or -1 whose check fits gives a digest, which is taken out of its other cells, and so on.
If cells are left, both tables are made four times as large and peeled anew. With d
digests recovered, the likeness is (|A| + |B| - d) / (|A| + |B| + d), the Jaccard
similarity of the sets; of two texts without paragraphs it is 1.

The fingerprint is the text's smallest table, written in hexadecimal after the number
of its digests; equal texts have equal ones.

Everything happens inside a row, after one shuffle that brings each document
next to its follower: doc_ids are cut into blocks of BLOCK consecutive numbers,
so no window is larger; the text that follows a block's last document comes from a
side table of one text per block. Sets of over PART digests are peeled in parts, dealt by digest.

Null texts are empty. Repeated doc_ids follow each other by text. A row with a
null doc_id has no place in the order: it follows itself and nothing follows it. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.common import stored

#: Consecutive doc_ids of a window.
BLOCK = 512
#: A line longer than this is taken in parts that end with a sentence.
PARAGRAPH = r"[^\n]{200,}?[.!?](?=[ \n]|$)|[^\n]+"
#: Cells of one of the three ranges of a fingerprint's table.
WIDTH = 8
#: Digests (of both texts) that are peeled together.
PART = 2048
#: Times that a table is made larger before the sets are compared directly.
RETRIES = 4
#: Rounds of peeling; each halves what is left, or nothing is left to peel.
ROUNDS = 64
EMPTY = "cast(array() as array<struct<c: bigint, n: int, k: bigint, x: bigint>>)"


def check(key: str) -> str:
    return f"(xxhash64({key}) & 4294967295L)"


def let(value: str, name: str, body: str) -> str:
    """Evaluate `value` once and use it as `name` in `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def digests(text: str) -> str:
    """Distinct paragraph digests of a text column."""
    return f"array_distinct(transform(regexp_extract_all({text}, r'{PARAGRAPH}', 0), p -> xxhash64(p)))"


def places(key: str, sign: str, width: str) -> str:
    """The three cells that a digest is added to."""
    fields = f"{sign} as n, {key} as k, {check(key)} as x"
    at = [f"{r} * {width} + (shiftrightunsigned({key}, {21 * r}) & ({width} - 1))" for r in range(3)]
    return "array(" + ", ".join(f"struct({a} as c, {fields})" for a in at) + ")"


def summed(entries: str) -> str:
    """Cells from entries: those of one cell are added up, cells that come to nothing are left out."""
    add = "struct(e.c as c, s.cell.n + e.n as n, s.cell.k ^ e.k as k, s.cell.x ^ e.x as x)"
    keep = "if(s.cell.n = 0 and s.cell.k = 0 and s.cell.x = 0, s.done, concat(s.done, array(s.cell)))"
    start = f"struct({EMPTY} as done, struct(-1L as c, 0 as n, 0L as k, 0L as x) as cell)"
    step = f"if(s.cell.c = e.c, struct(s.done as done, {add} as cell), struct({keep} as done, e as cell))"
    return f"aggregate(array_sort({entries}), {start}, (s, e) -> {step}, s -> {keep})"


def table(keys: str, width: str) -> str:
    """Invertible Bloom lookup table of an array of digests, as its non-empty cells."""
    return summed(f"flatten(transform({keys}, u -> {places('u', '1', width)}))")


def minus(a: str, b: str) -> str:
    """Difference of two tables of one width."""
    return summed(f"concat({a}, transform({b}, t -> struct(t.c as c, -t.n as n, t.k as k, t.x as x)))")


def peeled(cells: str, width: str) -> str:
    """struct(left, d, go): digests recovered from a difference, and the cells that could not be peeled."""
    pure = f"array_distinct(transform(filter(r.left, q -> abs(q.n) = 1 and {check('q.k')} = q.x), q -> struct(q.n as n, q.k as k)))"
    out = summed(f"concat(r.left, flatten(transform(got, g -> {places('g.k', '-g.n', width)})))")
    step = let(pure, "got", f"if(size(got) = 0, struct(r.left as left, r.d as d, false as go), struct({out} as left, r.d + size(got) as d, true as go))")
    return f"aggregate(sequence(1, {ROUNDS}), struct({cells} as left, 0 as d, true as go), (r, i) -> if(r.go, {step}, r))"


def differing(a: str, b: str, scale: int) -> str:
    """Number of digests in one of two sets only, by their tables; null where some cells could not be peeled."""

    def of(x: str, y: str) -> str:
        width = f"shiftleft({scale}L, cast(ceil(log2(greatest(size({x}) + size({y}), 8))) as int) - 1)"
        result = let(peeled(minus(table(x, "w"), table(y, "w")), "w"), "f", "if(size(f.left) = 0, f.d, null)")
        return let(width, "w", result)

    parts = f"(size({a}) + size({b})) div {PART} + 1"
    part = lambda s: f"filter({s}, u -> pmod(shiftrightunsigned(u, 40), np) = j)"
    many = let(parts, "np", f"aggregate(transform(sequence(0L, np - 1), j -> {let(part(a), 'pa', let(part(b), 'pb', of('pa', 'pb')))}), 0, (s, d) -> s + d)")
    return f"if({parts} = 1, {of(a, b)}, {many})"


def fingerprint(keys: str) -> str:
    cells = f"transform({table(keys, f'{WIDTH}L')}, t -> concat(lpad(hex(t.c), 2, '0'), lpad(hex(t.n), 2, '0'), lpad(hex(t.k), 16, '0'), lpad(hex(t.x), 8, '0')))"
    return f"lower(concat(hex(size({keys})), ':', array_join({cells}, '')))"


def with_likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the likeness of two digest columns; tables grow until all is peeled."""
    d = f"_{name}_d"
    rows = rows.withColumn(d, F.expr(differing(a, b, 1)))
    for retry in range(1, RETRIES + 1):
        rows = rows.withColumn(d, F.expr(f"if({d} is null, {differing(a, b, 4**retry)}, {d})"))
    # digests that share all cells and checks cannot be told apart by any table
    rows = rows.withColumn(d, F.expr(f"coalesce({d}, size(array_except({a}, {b})) + size(array_except({b}, {a})))"))
    both = f"(size({a}) + size({b}))"
    return rows.withColumn(name, F.expr(f"if({both} = 0, 1.0D, ({both} - {d}) / cast({both} + {d} as double))")).drop(d)


def next_lower(keys: DataFrame, depth: int = 2) -> DataFrame:
    """(k, lower) for distinct keys (k): the next lower key, null for the lowest. Windows hold BLOCK keys, but for the last level's."""
    if depth == 0:
        return keys.select("k", F.lead("k").over(Window.orderBy(F.desc("k"))).alias("lower"))
    blocked = keys.withColumn("g", F.expr(f"k div {BLOCK} - if(k % {BLOCK} < 0, 1, 0)"))
    tops = blocked.groupBy("g").agg(F.max("k").alias("top"))
    links = next_lower(tops.select(F.col("g").alias("k")), depth - 1)
    below = links.join(tops, links.lower == tops.g).select(F.col("k").alias("g"), "top")
    inside = F.lead("k").over(Window.partitionBy("g").orderBy(F.desc("k")))
    return blocked.withColumn("inside", inside).join(below, "g", "left").select("k", F.coalesce("inside", "top").alias("lower"))


def with_follower(docs: DataFrame) -> DataFrame:
    """(doc_id, text, following): following is the text of the next document in descending doc_id order, the first after the last."""
    block = f"doc_id div {BLOCK} - if(doc_id % {BLOCK} < 0, 1, 0)"
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tops = stored(rows.where("doc_id is not null").groupBy(F.expr(block).alias("block")).agg(F.max("doc_id").alias("top")), "iblt-tops")
    first = tops.agg(F.max("top")).first()[0]
    links = next_lower(tops.select(F.col("block").alias("k"))).select(F.col("k").alias("block"), F.col("lower").alias("b"))
    wanted = links.join(tops.select(F.col("block").alias("b"), "top"), "b", "left").select("block", F.coalesce("top", F.lit(first)).alias("doc_id"))
    wanted = stored(wanted, "iblt-wanted")
    border = stored(rows.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("border")), "iblt-border")
    border = stored(wanted.join(border, "doc_id").select("block", "border"), "iblt-borders")
    # rows without a doc_id are spread over blocks by text; they are last in them and nobody's next
    rows = rows.withColumn("block", F.coalesce(F.expr(block), F.expr("-1 - pmod(xxhash64(text), 1048576)")))
    order = Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), "text")
    rows = rows.withColumn("after", F.struct(F.lead("doc_id").over(order).alias("id"), F.lead("text").over(order).alias("text")))
    joined = rows.join(border, "block", "left")
    following = F.when(F.col("doc_id").isNull(), F.col("text")).when(F.col("after.id").isNotNull(), F.col("after.text")).otherwise(F.col("border"))
    return joined.select("doc_id", "text", following.alias("following"))


def edit_report(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and likenesses to the edited and the next text."""
    rows = with_follower(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = "cast(n_chars div 2 as int)"
    rows = rows.withColumn("edited", F.expr(f"concat(left(text, cast(n_chars - {half} as int)), left(following, {half}))"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.expr(digests("text")).alias("a"), F.expr(digests("edited")).alias("e"), F.expr(digests("following")).alias("f"))
    rows = rows.withColumn("fingerprint", F.expr(fingerprint("a"))).withColumn("edited_fingerprint", F.expr(fingerprint("e")))
    rows = with_likeness(with_likeness(rows, "a", "e", "near_edited"), "a", "f", "near_next")
    return rows.drop("a", "e", "f")


def op2_paragraph_iblt(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return edit_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
