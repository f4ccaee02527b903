"""Best-fit packing after Martello-Toth dominance reduction (operator 7)."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.shared import dealt, slices, text_bytes, written
from tidewell.llm.tokens import BATCH_BYTES, crc32, encoder


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, keeps_space: bool = False) -> DataFrame:
    """Tokenise every text, end it with id 0 and cut what is longer than ``capacity``.

    Gives ``doc_id, piece, start, length, ids_crc32`` and the piece's place among those of its length in its
    task: ``block`` (the task) and ``rank``. Written out, so that places stay what they were
    when an executor is lost. Null or empty text: one piece, the end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, block = encoder(tokenizer, keeps_space), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in slices(batches, text_bytes, BATCH_BYTES):
            rows = []
            every, starts = enc.encode(batch.column("text"))
            every = np.insert(every, starts[1:], 0).astype("<u4")
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                ids = every[starts[i] + i : starts[i + 1] + i + 1]
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    n = len(part)
                    rows.append((doc, k, at, n, crc32(part), block, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), KINDS, strict=True)], NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, block int, rank long"))


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "rank"]
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


class Plan:
    """Placement rules over lengths: so many pieces of a length, from a rank on, go to so many consecutive sequences.

    The plan is made from the number of pieces of each length alone. Every rule uses up the rest of a length or
    the rest of a class of equally filled sequences, so its size follows ``capacity``, not the number of pieces.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.used, self.sequences = capacity, dict(counts), dict.fromkeys(counts, 0), 0
        self.rules: list[tuple[int, int, int, int, int]] = []  # length, first rank, pieces, first sequence, offset
        self.lengths = sorted(x for x, n in counts.items() if n)

    def place(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.rules.append((length, self.used[length], n, sequence, offset))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            self.lengths.pop(bisect_left(self.lengths, length))

    def fix(self, parts: list[int], n: int) -> None:
        """``n`` sequences, each of one piece of every length in ``parts``."""
        offset = 0
        for x in parts:
            self.place(x, n, self.sequences, offset)
            offset += x
        self.sequences += n

    def two_of(self, room: int) -> bool:
        """Whether two of the remaining pieces fit into ``room`` together."""
        two = [x for x in self.lengths[:2] for _ in range(min(2, self.left[x]))][:2]
        return len(two) == 2 and sum(two) <= room

    def reduce(self) -> None:
        """Dominance: with the longest piece, fix a set that dominates every other set which could hold it.

        The longest piece alone, if none fits beside it; with the longest that fits, if that fills the sequence
        or if no two fit beside it. Each leaves an optimum attainable. Where neither holds for the longest piece, the
        search goes on with the next shorter one; what no rule fixes stays for best fit.
        """
        top = len(self.lengths) - 1
        while top >= 0:
            x = self.lengths[top]
            room = self.capacity - x
            twin = 2 * x == self.capacity and self.left[x] > 1
            i = bisect_left(self.lengths, room + 1) - 1
            mate = self.lengths[i] if i >= 0 else None
            if mate == x and self.left[x] < 2:
                mate = self.lengths[i - 1] if i else None
            if mate is None:
                self.fix([x], self.left[x])
            elif twin:
                self.fix([x, x], self.left[x] // 2)
            elif mate == x:
                top -= 1
                continue
            elif mate == room or not self.two_of(room):
                self.fix([x, mate], min(self.left[x], self.left[mate]))
            else:
                top -= 1
                continue
            top = min(top, len(self.lengths) - 1)

    def best_fit(self) -> None:
        """Best fit, longest first, over classes of sequences with equal room."""
        rooms: list[int] = []
        open_: dict[int, list[tuple[int, int]]] = {}

        def add(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in open_:
                    rooms.insert(bisect_left(rooms, room), room)
                open_.setdefault(room, []).append((first, n))

        while self.lengths:
            x = self.lengths[-1]
            i = bisect_left(rooms, x)
            if i == len(rooms):
                each = self.capacity // x
                n = self.left[x]
                full, rest = divmod(n, each)
                first = self.sequences
                for k in range(each):
                    if full:
                        self.place(x, full, first, k * x)
                for k in range(rest):
                    self.place(x, 1, first + full, k * x)
                self.sequences += full + bool(rest)
                add(self.capacity - each * x, first, full)
                if rest:
                    add(self.capacity - rest * x, first + full, 1)
                continue
            room = rooms[i]
            first, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            took = min(n, self.left[x])
            self.place(x, took, first, self.capacity - room)
            add(room - x, first, took)
            if took < n:
                add(room, first + took, n - took)


def plan(counts: dict[int, int], capacity: int) -> Plan:
    out = Plan(counts, capacity)
    out.reduce()
    out.best_fit()
    return out


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give every piece of ``pieces`` a sequence and an offset.

    Only the number of pieces of each length (at most ``capacity`` rows) goes to the driver, and only the plan
    goes back. A piece's rank among all of its length is its rank in its task plus what earlier tasks hold of
    that length; the plan's rule for that rank then names its sequence. Nothing is sorted or
    moved to one place, so a length that a third of all pieces have is no hot key.
    """
    per_task = cut.groupBy("block", "length").agg(F.count("*").alias("n"))
    order = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0)))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rules = sorted(plan(counts, capacity).rules)
    table = np.array(rules, np.int64).reshape(-1, 5)
    shared = cut.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value
        wide = int(rules[:, 1].max(initial=0) + rules[:, 2].max(initial=0) + 1)
        keys = [int(x) * wide + int(r) for x, r in rules[:, :2]]
        exact = np.array(keys, np.int64)
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "at"))
            rule = rules[np.searchsorted(exact, length * wide + rank, "right") - 1]
            sequence = rule[:, 3] + rank - rule[:, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in NAMES[:5]), pa.array(sequence, pa.int64()), pa.array(rule[:, 4], pa.int64())], [*NAMES[:5], "sequence_id", "offset"])

    placed = cut.join(dealt(bases.drop("n")), ["block", "length"]).select(*NAMES[:5], (F.col("base") + F.col("rank")).alias("at"))
    return placed.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 2048, keeps_space: bool = False) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    Pieces are made by ``pieces`` and placed by ``pack``; see there. Null or empty text takes one token, repeated
    rows are packed each, an empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer, capacity, keeps_space), capacity)
