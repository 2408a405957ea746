"""Packing of token sequences by exact complements, then best fit.

Pieces are counted by length, so the plan works on at most ``capacity`` counts whatever the number of documents.
From the longest length down, the gap that a piece leaves in a sequence is looked up among single lengths, sums
of two and sums of three, all that are free; every combination found is consumed as often as the counts allow. What remains goes
best-fit into the tightest open sequence, runs of equal lengths at once. Each step of the first part uses up a
length, and each run of the second fills or opens one kind of sequence, so the plan stays in proportion to the
capacity and is sent to the tasks as it is. Pieces find their place by their number within their length.

Null texts are empty and still hold the end id. Null document ids are kept. Repeated rows are packed each.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bestfit import best_fit_runs
from .common import numbered, saved
from .pieces import encoder


def tokenized_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, with_ids: bool = False,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document, the end id included."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        ids_of, end = encoder(vocabulary).ids, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, numbers, starts, lengths, crcs, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                got = ids_of(text.as_py()) + end
                for k, at in enumerate(range(0, len(got), 4 * capacity)):
                    piece = got[at : at + 4 * capacity]
                    rows.append(row)
                    numbers.append(k)
                    starts.append(at // 4)
                    lengths.append(len(piece) // 4)
                    crcs.append(zlib.crc32(piece))
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype("<i4"))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()),
                       pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class _Free:
    """Counts of free lengths, and the lengths as bits of one number, upwards and downwards.

    Two of the lengths sum to a total where the upward bits meet the downward bits shifted by the total, so a pair
    of any sum is looked up in one step over capacity/64 words.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n, self.capacity, self.up, self.down = [0] * (capacity + 1), capacity, 0, 0
        for length, n in counts.items():
            self.add(length, n)

    def add(self, length: int, n: int) -> None:
        self.n[length] += n
        if (self.n[length] > 0) != bool(self.up >> length & 1):
            self.up ^= 1 << length
            self.down ^= 1 << self.capacity - length

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two free lengths of this sum, the smallest with the largest."""
        met = self.up & self.down >> self.capacity - total
        if total % 2 == 0 and self.n[total // 2] == 1:
            met &= ~(1 << total // 2)
        if not met:
            return None
        low = (met & -met).bit_length() - 1
        return total - low, low

    def complement(self, gap: int, most: int) -> tuple[int, ...] | None:
        """One, two or three free lengths that sum to the gap. No combination with a length above ``most`` is there."""
        if gap > 3 * most:
            return None
        if self.n[gap]:
            return (gap,)
        if two := self.pair(gap):
            return two
        # the longest of three has a third of the gap at least
        for b in range(min(most, gap - 2), -(-gap // 3) - 1, -1):
            if self.n[b]:
                self.add(b, -1)
                two = self.pair(gap - b)
                self.add(b, 1)
                if two:
                    return (b, *two)
        return None


def packing_plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Places for all pieces: rows (length, rank, per sequence, first sequence, offset) and the number of sequences.

    The piece with number r of its length, in the last row with rank <= r, goes to sequence
    ``first + (r - rank) // per`` at ``offset + (r - rank) % per * length``.
    """
    free = _Free(counts, capacity)
    taken, rows, used = np.zeros(capacity + 1, np.int64), [], 0

    def consume(parts: list[tuple[int, int]], times: int) -> None:
        nonlocal used
        offset = 0
        for length, per in parts:
            rows.append((length, taken[length], per, used, offset))
            taken[length] += per * times
            free.add(length, -per * times)
            offset += per * length
        used += times

    if free.n[capacity]:
        consume([(capacity, 1)], free.n[capacity])
    for a in range(capacity - 1, 0, -1):
        # each round uses up a length, and lengths above a found nothing in their turn
        while free.n[a]:
            free.add(a, -1)
            rest = free.complement(capacity - a, a)
            free.add(a, 1)
            if rest is None:
                break
            parts = {x: (a, *rest).count(x) for x in (a, *rest)}
            consume(list(parts.items()), min(free.n[x] // k for x, k in parts.items()))
    left = [(x, free.n[x]) for x in range(capacity, 0, -1) if free.n[x]]
    runs, bins = best_fit_runs(left, capacity)
    # a sequence's fill at each run: the same for all bins of a run, kept by their first bin
    fills: dict[int, int] = {}
    starts = sorted({r.first_bin for r in runs} | {r.first_bin + -(-r.n // r.per_bin) for r in runs})
    where = {b: i for i, b in enumerate(starts)}
    for r in runs:
        last = where[r.first_bin + -(-r.n // r.per_bin)]
        at = where[r.first_bin]
        offset, rank, number = fills.get(r.first_bin, 0), r.rank, r.first_bin
        rows.append((r.size, taken[r.size] + rank, r.per_bin, used + number, offset))
        each = min(r.per_bin, r.n) * r.size
        for i in range(at, last):
            fills[starts[i]] = offset + each
    order = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return order, used + bins


def packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to the pieces, a written table with a ``length`` column."""
    counts = {x.length: x.n for x in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan, _ = packing_plan(counts, capacity)
    keys = plan[:, 0] << 40 | plan[:, 1]
    order = [c for c in ("doc_id", "piece", "ids_crc32") if c in pieces.columns]

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            number = batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, length << 40 | number, "right") - 1
            past, per = number - plan[at, 1], plan[at, 2]
            batch = batch.remove_column(batch.schema.names.index("_rank"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(plan[at, 3] + past // per), pa.array(plan[at, 4] + past % per * length)],
                [*batch.schema.names, "sequence_id", "offset"])

    ranked = numbered(pieces, ["length"], order, "_rank").select(*pieces.columns, "_rank")
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack all documents; one row for each piece with its sequence and offset there."""
    pieces = saved(tokenized_pieces(docs, vocabulary, end_id, capacity, with_ids, id_col, text_col), "pieces")
    return packed(pieces, capacity)
