"""Packing of documents into sequences: Martello-Toth dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so the instance is a histogram of at most ``capacity``
counts, whatever the number of documents.  ``plan`` works on the histogram alone: it fixes the sets that
provably dominate every other way to fill a sequence with their largest item, and best-fits the
rest in descending order.  Pieces are then dealt to the plan's sequences by their rank among the pieces of equal length, which comes
from counts by partition, so no length, however common, meets in one task.

Defined results: null text is empty text; every document has its end id, so none is without a piece;
equal rows and equal doc_ids each get pieces of their own; an empty table gives an empty result; other columns are ignored.
A text of any length is encoded whole and cut into pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import materialise, tidy, tune
from .tokens import encoder, with_end

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, at long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _sums(counts: dict[int, int], most: int) -> int:
    """Bit s is set if some items add up to s <= most."""
    reach, full = 1, (1 << (most + 1)) - 1
    for length, n in counts.items():
        step = 1
        while n > 0 and length * step <= most:
            take = min(step, n)
            reach |= (reach << (length * take)) & full
            n -= take
            step *= 2
    return reach


def _second(counts: dict[int, int], room: int) -> int:
    """The largest y for which another item x >= y has x + y <= room; 0 if no two items fit."""
    sizes = sorted(counts)
    for y in reversed(sizes):
        if 2 * y <= room and (counts[y] > 1 or any(y < x <= room - y for x in sizes)):
            return y
    return 0


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(fixed sets with how often each is used, what is left).

    Let j be the largest item.  A set dominates the others that hold j if whatever they hold beside j could take the places of the
    set's own items elsewhere.  Three kinds of sets are fixed as long as one is found: j alone if nothing fits beside it;
    {j, k} if k fills the sequence or no sum of items that fits beats k; and {j, a, b} if at most two items fit beside
    j, a is the largest that fits and b the largest beside it, and no pair that fits has a smaller item above b.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(items: tuple[int, ...], times: int) -> None:
        fixed.append((items, times))
        for x in items:
            left[x] -= times
        for x in set(items):
            if left[x] <= 0:
                del left[x]

    for j in sorted(left, reverse=True):
        room = capacity - j
        while left.get(j, 0) > 0:
            beside = {k: n - (k == j) for k, n in left.items() if k <= room and n - (k == j) > 0}
            if not beside:
                fix((j,), left[j])
                break
            k = max(beside)
            if k == room or _sums(beside, room).bit_length() - 1 <= k:
                fix((j, k), left[j] // 2 if k == j else min(left[j], left[k]))
                continue
            least = [x for x in sorted(beside) for _ in range(min(beside[x], 3))][:3]
            rest = {x: n - (x == k) for x, n in beside.items() if x <= room - k and n - (x == k) > 0}
            if not rest or (len(least) == 3 and sum(least) <= room) or max(rest) < _second(beside, room):
                break
            items = (j, k, max(rest))
            fix(items, min(left[x] // items.count(x) for x in items))
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in descending order, equal sequences together: (lengths of a sequence, how many such)."""
    by_room: dict[int, Counter] = defaultdict(Counter)  # free room -> sequences of that room
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n > 0:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                deep = min(capacity // length, n)
                times = n // deep
                by_room[capacity - length * deep][(length,) * deep] += times
                n -= times * deep
                continue
            kinds = by_room[room]
            kind, have = next(iter(kinds.items()))
            deep = min(room // length, n)
            times = min(have, n // deep)
            if times == have:
                del kinds[kind]
                if not kinds:
                    del by_room[room]
            else:
                kinds[kind] -= times
            by_room[room - length * deep][kind + (length,) * deep] += times
            n -= times * deep
    return [(kind, times) for kinds in by_room.values() for kind, times in kinds.items()]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sets of lengths and how many sequences hold each; every item is used once."""
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(sets: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, items in a sequence, first sequence, offset of the first item) in order of rank."""
    rows, used, sequence = defaultdict(list), Counter(), 0
    for lengths, times in sets:
        offset = 0
        for length, n in Counter(lengths).items():
            rows[length].append((used[length], n, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def cut(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length): documents over ``most`` ids are cut, their first piece takes what doesn't fill one."""
    pieces = np.maximum(-(-n // most), 1)
    doc = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = n - (pieces - 1) * most
    start = np.where(piece == 0, 0, first[doc] + (piece - 1) * most)
    return doc, piece, start, np.where(piece == 0, first[doc], most)


def pieces(docs: DataFrame, tokenizer: str, pattern: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of all documents as a written table. ``at`` counts pieces of equal length within a partition. Columns: ``PIECES``."""

    def run(batches):
        from pyspark import TaskContext

        part, enc, seen = TaskContext.get().partitionId(), encoder(tokenizer, pattern), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, counts = with_end(*enc.encode(batch.column(1)), end_id)
            doc, piece, start, length = cut(counts, capacity)
            first = (np.cumsum(counts) - counts)[doc] + start
            data = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(data[4 * a : 4 * (a + b)]) for a, b in zip(first.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            sorted_ = length[order]
            at = np.empty(len(length), np.int64)
            at[order] = seen[sorted_] + np.arange(len(sorted_)) - np.searchsorted(sorted_, sorted_)
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(at, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "at"],
            )
        enc._reset()  # a worker that goes on to other stages needs the room of the cache

    return materialise(docs.select("doc_id", "text").mapInArrow(tidy(run), PIECES), "pieces")


def pack(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """A row for each piece with its sequence and place there. Columns: ``PACKED``."""
    tune(docs.sparkSession)
    table = pieces(docs, tokenizer, pattern, end_id, capacity)
    by_part = table.groupBy("part", "length").agg(F.count("*").alias("n"))
    # at most `capacity` rows reach the driver
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = slots(plan(counts, capacity))
    before = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = table.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at")).alias("rank"))

    def run(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for value in np.unique(length).tolist():
                rows, own = places[value], np.flatnonzero(length == value)
                slot = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - slot[:, 0]
                sequence[own] = slot[:, 2] + nth // slot[:, 1]
                offset[own] = slot[:, 3] + nth % slot[:, 1] * value
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), batch.column(3).cast(pa.int64()), batch.column(4), pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(tidy(run), PACKED)
