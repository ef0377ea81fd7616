"""Fill-in-middle transformation on ropes.

A text is cut into units, the matches of a pattern from left to right (by default code
points). ``Rope`` keeps runs of at most ``LEAF`` units in the leaves of a balanced binary
tree; leaves cache how many units and code points they hold, inner nodes the sums of both.
A document's rope is split at two unit ranks that its id decides; prefix, middle and
suffix are subtrees then and are concatenated anew with sentinels between them, which are
leaves of no unit. The way back builds a rope of the output, finds the sentinels, splits
the tree at their code-point ranks and concatenates the three subtrees in their first
order. Splits and concatenations make new nodes along one path only; text is never copied.

Forms: ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) and ``spm``
(suffix, prefix, middle). Texts that are empty or hold a sentinel stay plain, so that
every output can be undone.

Defined cases: null text is empty; a null doc_id counts as an empty string in the hash;
repeated rows give equal outputs; further columns are ignored. A task holds one text, its
leaves and its output at a time, so memory goes with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Percentages: documents that stay plain, and of the others those in the order suffix, prefix, middle.
PLAIN, SPM = 10, 20
SEED = 1
#: Units of a leaf.
LEAF = 1024
#: The unit: one code point.
CODE_POINT = r"(?s:.)"


class Rope:
    """A node: a leaf with its text, or two ropes; with units, code points and height."""

    __slots__ = ("chars", "height", "left", "right", "text", "units")

    def __init__(self, text: str, units: int) -> None:
        self.text, self.units, self.chars, self.height = text, units, len(text), 0
        self.left = self.right = None

    @staticmethod
    def of(text: str, unit: str = CODE_POINT) -> Rope:
        """A balanced rope of a text. What the pattern does not match belongs to the unit behind it, at the end to the last one."""
        if unit == CODE_POINT:
            leaves = [Rope(text[i : i + LEAF], min(LEAF, len(text) - i)) for i in range(0, len(text), LEAF)]
        else:
            ends = [m.end() for m in regex.compile(unit).finditer(text) if m.end() > m.start()]
            if ends:
                ends[-1] = len(text)
            cuts = [0, *ends[LEAF - 1 :: LEAF]]
            if ends and cuts[-1] != ends[-1]:
                cuts.append(ends[-1])
            leaves = [Rope(text[a:b], min(LEAF, len(ends) - k * LEAF)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            if text and not ends:
                leaves = [Rope(text, 0)]
        while len(leaves) > 1:
            leaves = [_node(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else EMPTY

    def leaves(self) -> Iterator[str]:
        todo = [self]
        while todo:
            at = todo.pop()
            if at.left is None:
                yield at.text
            else:
                todo += (at.right, at.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


EMPTY = Rope("", 0)


def _node(a: Rope, b: Rope) -> Rope:
    out = Rope.__new__(Rope)
    out.text, out.left, out.right = "", a, b
    out.units, out.chars, out.height = a.units + b.units, a.chars + b.chars, 1 + max(a.height, b.height)
    return out


def _level(a: Rope, b: Rope) -> Rope:
    """A node over two ropes whose heights differ by two at most, with one or two rotations."""
    if a.height > b.height + 1:
        if a.left.height < a.right.height:
            return _node(_node(a.left, a.right.left), _node(a.right.right, b))
        return _node(a.left, _node(a.right, b))
    if b.height > a.height + 1:
        if b.right.height < b.left.height:
            return _node(_node(a, b.left.left), _node(b.left.right, b.right))
        return _node(_node(a, b.left), b.right)
    return _node(a, b)


def concat(*parts: Rope) -> Rope:
    """The ropes in a row; the taller one is followed down to where the other fits."""
    out = EMPTY
    for p in parts:
        out = _join(out, p)
    return out


def _join(a: Rope, b: Rope) -> Rope:
    if not a.chars or not b.chars:
        return b if not a.chars else a
    if a.height > b.height + 1:
        return _level(a.left, _join(a.right, b))
    if b.height > a.height + 1:
        return _level(_join(a, b.left), b.right)
    return _node(a, b)


def split(rope: Rope, rank: int, by: str = "units", unit: str = CODE_POINT) -> tuple[Rope, Rope]:
    """What lies before a rank and behind it, counted in units or in ``chars``.

    Leaves without units between two ranks stay on the left.
    """
    path, here = [], rope
    while here.left is not None:
        held = getattr(here.left, by)
        path.append((here, rank > held))
        here, rank = (here.right, rank - held) if rank > held else (here.left, rank)
    left, right = _cut(here, rank, by, unit)
    for node, went_right in reversed(path):
        left, right = (_join(node.left, left), right) if went_right else (left, _join(right, node.right))
    return left, right


def _cut(leaf: Rope, rank: int, by: str, unit: str) -> tuple[Rope, Rope]:
    if rank <= 0 or not leaf.chars:
        return EMPTY, leaf
    if rank >= getattr(leaf, by):
        return leaf, EMPTY
    if unit == CODE_POINT:
        return Rope(leaf.text[:rank], rank), Rope(leaf.text[rank:], leaf.units - rank)
    if by == "chars":
        inside = sum(m.end() <= rank for m in regex.compile(unit).finditer(leaf.text))
        return Rope(leaf.text[:rank], inside), Rope(leaf.text[rank:], leaf.units - inside)
    ends = [m.end() for m in regex.compile(unit).finditer(leaf.text) if m.end() > m.start()]
    return Rope(leaf.text[: ends[rank - 1]], rank), Rope(leaf.text[ends[rank - 1] :], leaf.units - rank)


def transform(text: str, cut_1: int, cut_2: int, plain: int, spm: int, unit: str = CODE_POINT) -> tuple[int, str, int | None, int | None, Rope]:
    """Units, form, code points of prefix and middle, and the rope of the output. The last four arguments are hashes."""
    rope = Rope.of(text, unit)
    n = rope.units
    if not text or plain % 100 >= 100 - PLAIN or any(s in text for s in SENTINELS):
        return n, "plain", None, None, rope
    a, b = sorted((cut_1 % (n + 1), cut_2 % (n + 1)))
    head, suffix = split(rope, b, unit=unit)
    prefix, middle = split(head, a, unit=unit)
    p, s, m = (Rope(x, 0) for x in SENTINELS)
    if spm % 100 < SPM:
        return n, "spm", prefix.chars, middle.chars, concat(s, suffix, p, prefix, m, middle)
    return n, "psm", prefix.chars, middle.chars, concat(p, prefix, s, suffix, m, middle)


def restore(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    rope = Rope.of(output)
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    # sentinels begin with a character that is nowhere else in them, so the first find behind the last one is the real one
    at_2 = output.index(second, len(first))
    at_3 = output.index(MIDDLE, at_2 + len(second))
    _, rope = split(rope, len(first), "chars")
    one, rope = split(rope, at_2 - len(first), "chars")
    _, rope = split(rope, len(second), "chars")
    two, rope = split(rope, at_3 - at_2 - len(second), "chars")
    _, middle = split(rope, len(MIDDLE), "chars")
    return str(concat(one, middle, two) if form == "psm" else concat(two, middle, one))


def hashes(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a document, from the sha256 of seed and id."""
    hex_ = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hex_, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, unit: str = CODE_POINT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of docs."""
    prepare(docs.sparkSession)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for b in batches:
            for part in _few(b):
                cols = [c.to_pylist() for c in part.columns[1:]]
                rows = [transform(t or "", *h, unit) for t, *h in zip(*cols, strict=True)]
                out = [[*r[:4], str(r[4])] for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", "text", *(h.alias(f"h{k}") for k, h in enumerate(hashes(F.col("doc_id"), seed), 1))).mapInArrow(run, schema)


def restored(rows: DataFrame) -> DataFrame:
    """rows of fill_in_middle() with a column ``restored``, the text rebuilt from output and form alone."""
    names = rows.columns
    at_output, at_form = names.index("output"), names.index("form")

    def run(batches):
        for b in batches:
            for part in _few(b):
                texts = [restore(o, f) for o, f in zip(part.column(at_output).to_pylist(), part.column(at_form).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "restored"])

    return rows.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, restored string")


def _few(batch: pa.RecordBatch, rows: int = 16) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restored(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM d),
y AS (SELECT doc_id, t, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
z AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM y)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM z
"""
