"""Fill-in-the-middle transformation over an indexable skip list.

A text is cut into units (lines with their line break). The units stand in a skip list whose express lanes carry two
widths for each step: how many units and how many code points it passes. Going down the lanes by accumulated widths
reaches the place after any number of units, with its code point, in a logarithmic number of steps; the two cuts of a
document are found that way and the text is sliced there. Which cuts and which form a document takes follows from a
SHA-256 of its id and a seed alone, so a task that runs again gives the same.

Forms: ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix, middle), each part
behind its mark. A text that is empty or holds one of the marks stays plain, so ``restored`` can always rebuild it.

Null texts are empty and give the empty plain output. A null id counts as an empty one in the hash. Rows keep their
number; repeated rows each have the same result. A text of one line, however long, is one unit; memory holds one text
with its units at a time. Equal cuts give an empty middle. Empty tables give empty results. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE = re.compile(r"[^\n]*\n|[^\n]+")
MARKS = ("<P>", "<S>", "<M>")


class SkipList:
    """An indexable skip list of units; node 0 is the head.

    Each node has a tower of lanes; lane k of a node leads to the next node whose tower is higher than k. ``step``,
    ``units`` and ``points`` hold, for each node, where each of its lanes leads and how many units and code points it
    passes. The height of a tower follows from the number of appends alone.
    """

    MOST = 24

    def __init__(self, items=()):
        self.step = [[None] * self.MOST]
        self.units = [[0] * self.MOST]
        self.points = [[0] * self.MOST]
        self.high, self.n, self.chars = 1, 0, 0
        self._last = [(0, 0, 0)] * self.MOST  # the last node of each lane, and the units and code points up to its end
        for x in items:
            self.append(x)

    def _height(self) -> int:
        mixed = (self.n * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & (1 << 64) - 1
        mixed = (mixed ^ mixed >> 31) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        mixed ^= mixed >> 29
        high = 1
        while mixed & 3 == 0 and high < self.MOST:
            high, mixed = high + 1, mixed >> 2
        return high

    def append(self, item: str) -> None:
        node, high = len(self.step), self._height()
        self.n, self.chars = self.n + 1, self.chars + len(item)
        self.step.append([None] * high)
        self.units.append([0] * high)
        self.points.append([0] * high)
        self.high = max(self.high, high)
        for lane in range(high):
            before, units, points = self._last[lane]
            self.step[before][lane] = node
            self.units[before][lane] = self.n - units
            self.points[before][lane] = self.chars - points
            self._last[lane] = (node, self.n, self.chars)

    def reach(self, rank: int) -> int:
        """Code points in the first ``rank`` units."""
        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        node = points = 0
        for lane in range(self.high - 1, -1, -1):
            while (to := self.step[node][lane]) is not None and self.units[node][lane] <= rank:
                rank -= self.units[node][lane]
                points += self.points[node][lane]
                node = to
        return points


def draws(doc_id, seed: int) -> list[int]:
    """The first four 32-bit numbers of the SHA-256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(doc_id, text: str, seed: int = 7, rate: int = 100, spm: int = 50, marks=MARKS) -> tuple:
    """(units, form, prefix code points, middle code points, output) of one text; rate and spm in per cent."""
    units = SkipList(LINE.findall(text))
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return units.n, "plain", None, None, text
    first, second = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.reach(first), units.reach(second)
    p, s, m = marks
    if h4 % 100 < spm:
        return units.n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
    return units.n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))


def restore(form: str, output: str, marks=MARKS) -> str:
    """The text that was given, from a form and its output."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (s, p) if form == "spm" else (p, s)
    head, _, middle = output.partition(m)
    one, _, two = head.removeprefix(first).partition(second)
    return two + middle + one if form == "spm" else one + middle + two


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, marks=MARKS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Per row: the id, n, form, prefix_chars, middle_chars and the output text."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            found = [transform(i.as_py(), t.as_py() or "", seed, rate, spm, marks) for i, t in zip(*batch.columns, strict=True)]
            columns = zip(*found, strict=True) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(outputs: DataFrame, marks=MARKS) -> DataFrame:
    """The rows of ``transformed`` with one more column, ``restored``, rebuilt from form and output alone."""
    form, output = outputs.columns.index("form"), outputs.columns.index("output")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [restore(f.as_py(), o.as_py(), marks) for f, o in zip(batch.column(form), batch.column(output), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "restored"])

    schema = ", ".join(f"`{n}` {t}" for n, t in outputs.dtypes) + ", restored string"
    return outputs.mapInArrow(run, schema)
