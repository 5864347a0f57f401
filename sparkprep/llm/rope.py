"""Fill-in-the-middle on ropes.

A text is a binary tree of leaves of about LEAF bytes of UTF-8. Every node caches the units, code points and bytes
below it; a unit is a run of the letters A-Z and a-z, or one other code point, and leaves hold whole units. Cutting at
two unit ranks walks down the tree by these counts, and only the two leaves that hold the cuts are looked into; the
three parts are put together in another order, with sentinels between, by making new inner nodes. Restoring a text
builds a rope of the written output, finds its sentinels, cuts the tree there and joins the parts in their order.

A document's draws are four 32-bit numbers from the SHA-256 of seed and key: two cuts, whether it is changed at all
(``rate`` percent are), and its form (``spm`` percent suffix first, else prefix first). Every row stands alone:
nothing is shuffled, and a lost task repeats its rows.

Defined cases: a null text counts as empty, and an empty text stays plain, as does one that contains a sentinel; the
key may be of any type, and is taken as text, a null one as the empty text; rows that repeat are changed alike; texts
of any length are one tree, with one copy of the text beside the tree; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkprep.llm.common import slices, table

LEAF = 16 << 10
SENTINELS = ("<P>", "<S>", "<M>")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Rope:
    """A leaf, with data, or an inner node, with left and right."""

    __slots__ = ("chars", "data", "left", "right", "size", "units")

    def __init__(self, data=None, left: Rope | None = None, right: Rope | None = None):
        self.data, self.left, self.right = data, left, right
        if data is None:
            self.units, self.chars, self.size = left.units + right.units, left.chars + right.chars, left.size + right.size
        else:
            starts, joined = _marks(data)
            self.size = len(data)
            self.chars = int(np.count_nonzero(starts))
            self.units = self.chars - int(np.count_nonzero(joined))

    def leaves(self) -> Iterator[memoryview]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.data is not None:
                yield node.data
            else:
                todo += [node.right, node.left]


def _marks(data) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes begin a code point; which, from the second, are letters after letters."""
    raw = np.frombuffer(data, np.uint8)
    letter = _LETTER[raw]
    return (raw & 0xC0) != 0x80, letter[1:] & letter[:-1]


def concat(*parts: Rope | None) -> Rope | None:
    out = None
    for p in parts:
        out = p if out is None else out if p is None else Rope(left=out, right=p)
    return out


def build(data: bytes, leaf: int = LEAF) -> Rope | None:
    """The balanced rope of a text in UTF-8; leaves end where a unit does."""
    view, nodes, at = memoryview(data), [], 0
    while at < len(data):
        end = min(at + leaf, len(data))
        while end < len(data) and ((data[end] & 0xC0) == 0x80 or (_LETTER[data[end]] and _LETTER[data[end - 1]])):
            end += 1
        nodes.append(Rope(view[at:end]))
        at = end
    while len(nodes) > 1:
        nodes = [Rope(left=nodes[i], right=nodes[i + 1]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0] if nodes else None


def split(node: Rope | None, rank: int, by: str = "units") -> tuple[Rope | None, Rope | None]:
    """The rope before and from a rank, counted in units, chars or size (bytes)."""
    if node is None or rank <= 0:
        return None, node
    if rank >= getattr(node, by):
        return node, None
    if node.data is None:
        ahead = getattr(node.left, by)
        if rank < ahead:
            a, b = split(node.left, rank, by)
            return a, concat(b, node.right)
        a, b = split(node.right, rank - ahead, by)
        return concat(node.left, a), b
    at = rank
    if by != "size":
        starts, joined = _marks(node.data)
        if by == "units":
            starts[1:] &= ~joined
        at = int(np.flatnonzero(starts)[rank])
    return Rope(node.data[:at]), Rope(node.data[at:])


def rearrange(rope: Rope | None, low: int, high: int, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[Rope, int, int]:
    """(output, code points of the prefix, of the middle): the rope cut at two unit ranks, its parts in the order of the form."""
    prefix, rest = split(rope, low)
    middle, suffix = split(rest, high - low)
    p, s, m = (Rope(memoryview(x.encode())) for x in sentinels)
    out = concat(s, suffix, p, prefix, m, middle) if form == "spm" else concat(p, prefix, s, suffix, m, middle)
    return out, prefix.chars if prefix else 0, middle.chars if middle else 0


def invert(output: bytes, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> Rope | None:
    """The text from its output: the rope of the output is cut at its sentinels, and its parts return to their order.

    A text that is changed contains no sentinel, and none can begin in a text and end in a sentinel, or the other way round, as
    sentinels must not share a beginning with another's end; so the first ones found are those that were put in."""
    if form == "plain":
        return build(output)
    p, s, m = (x.encode() for x in sentinels)
    first, second = (s, p) if form == "spm" else (p, s)
    b = output.find(second, len(first))
    c = output.find(m, b + len(second))
    if not output.startswith(first) or b < 0 or c < 0:
        raise ValueError(f"the output lacks a sentinel of form {form}")
    rope = build(output)
    rope, end = split(rope, c, "size")
    rope, late = split(rope, b, "size")
    early, late, middle = split(rope, len(first), "size")[1], split(late, len(second), "size")[1], split(end, len(m), "size")[1]
    return concat(late, middle, early) if form == "spm" else concat(early, middle, late)


def draws(seed: str, key: object) -> list[int]:
    """The first four 32-bit numbers of the SHA-256 of seed and key."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 of each row; nulls are empty."""
    for x in column:
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def fill_in_middle(docs: DataFrame, seed: str = "1", rate: int = 90, spm: int = 20, sentinels: tuple[str, str, str] = SENTINELS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain), output."""
    if any(a[:i] == b[-i:] for a in sentinels for b in sentinels for i in range(1, min(len(a), len(b)) + (a != b))):
        raise ValueError("sentinels must not share a beginning with an end")
    schema = T.StructType([T.StructField("__sp_key", docs.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])
    marks = [x.encode() for x in sentinels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__sp_text"):
                out: list[list] = [[] for _ in range(5)]
                for name, data in zip(batch.column("__sp_name").to_pylist(), text_bytes(batch.column("__sp_text")), strict=True):
                    h1, h2, h3, h4 = draws(seed, name)
                    rope = build(data)
                    n = rope.units if rope else 0
                    if not data or h3 % 100 >= rate or any(x in data for x in marks):
                        row = (n, "plain", None, None, data)
                    else:
                        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                        form = "spm" if h4 % 100 < spm else "psm"
                        changed, before, between = rearrange(rope, low, high, form, sentinels)
                        row = (n, form, before, between, b"".join(changed.leaves()))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                n, form, before, between, output = out
                yield pa.RecordBatch.from_arrays([batch.column("__sp_key"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())], schema.names)

    rows = docs.select(F.col(key).alias("__sp_key"), F.col(key).cast("string").alias("__sp_name"), F.col(text).cast("string").alias("__sp_text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("__sp_key", key)


def restore(changed: DataFrame, sentinels: tuple[str, str, str] = SENTINELS, form: str = "form", output: str = "output", name: str = "restored") -> DataFrame:
    """changed with one more column: the text that each output was made of, from output and form alone."""
    schema = T.StructType([*changed.schema, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, output):
                texts = []
                for kind, data in zip(batch.column(form).to_pylist(), text_bytes(batch.column(output)), strict=True):
                    rope = invert(data, kind, sentinels)
                    texts.append(b"".join(rope.leaves()) if rope else b"")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], schema.names)

    return changed.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
h AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(hex, 1, 8))::BIGINT AS h1, ('0x' || substr(hex, 9, 8))::BIGINT AS h2,
         ('0x' || substr(hex, 17, 8))::BIGINT AS h3, ('0x' || substr(hex, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high, u,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, coalesce(array_to_string(u[1:low], ''), '') AS prefix, coalesce(array_to_string(u[low + 1:high], ''), '') AS middle,
         coalesce(array_to_string(u[high + 1:n], ''), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
