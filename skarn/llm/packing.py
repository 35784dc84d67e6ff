"""Best-fit packing of tokenised documents by linear grouping (op 1).

Lengths are whole numbers up to the capacity, so everything that decides where pieces
go is a table of counts by length, of at most ``capacity`` rows whatever the corpus:

1. Large lengths, in descending order, are cut into groups of equal cardinality, and
   each length is rounded up to the longest of its group.
2. The rounded problem has few sizes. A linear programme over configurations (how many
   pieces of each size share a sequence) is solved by column generation, and rounded
   down; what is left over joins the sequences best-fit.
3. Actual pieces take the places of the rounded ones, each the longest left that its
   place was planned for; a configuration's last one, the longest that the others leave
   room for, unless a sliver of room would be left. Which piece of a length goes where is told by its rank within the length.
4. What is left over and the small pieces, longest first, go best-fit into
   what room there is, then to new sequences.

Ranks within a length are counted per task and summed over tasks, so no group is gathered.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.bpe import encoder
from skarn.llm.shared import slices, trim, written

#: Lengths over this part of the capacity are large; groups that they are rounded in.
LARGE_PART, GROUPS = 1 / 6, 64
#: A configuration's last place waits for the best fit rather than leave a room below this, but not none: few pieces would fit there.
SLIVER = 30


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised pieces: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``task``, ``rank`` within task and length."""
    schema = docs.select(id_col).schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("task", "integer"), ("rank", "long")):
        schema = schema.add(name, kind)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen, task = encoder(vocabulary), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        for b in slices(it):
            for first, after, ids, offsets in coder.encode(b.column(1)):
                row, piece, start, length, crc, rank = [], [], [], [], [], []
                for k in range(after - first):
                    own = np.concatenate([ids[offsets[k] : offsets[k + 1]], end])
                    for n, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        row.append(first + k)
                        piece.append(n)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        rank.append(seen[len(part)])
                        seen[len(part)] += 1
                long = [pa.array(x, pa.int64()) for x in (start, length, crc)]
                columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *long]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([task] * len(row), pa.int32()), pa.array(rank, pa.int64())], schema.names)
        trim()

    return docs.select(id_col, text_col).mapInArrow(batches, schema)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations of ``sizes`` (distinct) and how often each is used, covering at most ``demand``.

    Column generation: the dual prices of the cover programme are priced by a knapsack
    over the capacity until no configuration is worth more than one sequence.
    """
    k = len(sizes)
    if not k:
        return []
    basis = np.diag([float(capacity // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(40 * k + 200):
        use = np.linalg.solve(basis, need)
        price = np.linalg.solve(basis.T, np.ones(k))
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        order = [i for i in np.argsort([-p / s for p, s in zip(price, sizes, strict=True)]) if price[i] > 1e-9]
        for i in order:
            s = sizes[i]
            for lo in range(s, capacity + 1, s):  # room by room of one piece, so that pieces can repeat
                hi = min(lo + s, capacity + 1)
                better = best[lo - s : hi - s] + price[i] > best[lo:hi] + 1e-12
                best[lo:hi] = np.where(better, best[lo - s : hi - s] + price[i], best[lo:hi])
                choice[lo:hi] = np.where(better, i, choice[lo:hi])
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        # Walk back; rooms without a choice hold what a smaller room holds.
        while room > 0:
            while room > 0 and choice[room] < 0:
                room -= 1
            if room <= 0:
                break
            i = choice[room]
            column[i] += 1
            room -= sizes[i]
            if column @ price >= best[capacity] - 1e-9:
                break
        step = np.linalg.solve(basis, column)
        can = step > 1e-9
        if not can.any() or column @ price <= 1 + 1e-7:
            break
        ratio = np.where(can, use / np.where(can, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    use = np.linalg.solve(basis, need)
    out, left = [], np.array(demand, np.int64)
    for j in np.argsort(-use):
        column = np.round(basis[:, j]).astype(np.int64)
        times = min([int(use[j] + 1e-9), *(int(left[i] // column[i]) for i in np.flatnonzero(column))])
        if times > 0:
            out.append((column, times))
            left -= column * times
    return out


class Plan:
    """Where each (length, rank) goes: runs of ranks, each filling a run of sequences ``per`` pieces at a time."""

    def __init__(self, counts: dict[int, int], capacity: int, groups: int = GROUPS, large_part: float = LARGE_PART):
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, pieces, first sequence, pieces a sequence
        self.taken = dict.fromkeys(counts, 0)
        self.rooms: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences
        self.sequences = self.configured = 0
        left = dict(counts)
        if n := left.pop(capacity, 0):
            self.put(capacity, self.new(n), n, 1)
        large = {s: c for s, c in left.items() if s > capacity * large_part}
        self.substitute(large, capacity, groups)
        self.configured = sum(self.taken[s] for s in large)  # large pieces that configurations placed
        for s in sorted(left, reverse=True):
            self.best_fit(s, left[s] - self.taken[s], capacity)

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, sequence: int, pieces: int, per: int) -> None:
        self.rows.append((length, self.taken[length], pieces, sequence, per))
        self.taken[length] += pieces

    def substitute(self, large: dict[int, int], capacity: int, groups: int) -> None:
        """Rounds up within groups of equal cardinality, plans with few sizes, puts actual lengths in."""
        total = sum(large.values())
        if not total:
            return
        each = -(-total // groups)
        queues: list[list[list[int]]] = []  # of each group, its lengths, longest first, with counts
        room = 0
        for s in sorted(large, reverse=True):
            n = large[s]
            while n:
                if not room:
                    queues.append([])
                    room = each
                part = min(n, room)
                queues[-1].append([s, part])
                n, room = n - part, room - part
        demand: dict[int, int] = {}
        for q in queues:
            demand[q[0][0]] = demand.get(q[0][0], 0) + sum(n for _, n in q)
        sizes = sorted(demand, reverse=True)
        left = dict(large)
        lengths = sorted(large)
        for column, times in configurations(sizes, [demand[s] for s in sizes], capacity):
            runs = [(self.new(times), times, capacity)]
            places = [sizes[i] for i in np.flatnonzero(column) for _ in range(column[i])]
            for k, planned in enumerate(places, 1):
                after = []
                for first, n, room in runs:
                    while n:
                        # No piece planned for was longer than its place, so one that fits is always left.
                        length = lengths[bisect_right(lengths, room if k == len(places) else planned) - 1]
                        if 1 < k == len(places) and 0 < room - length < SLIVER:
                            after.append((first, n, room))
                            break
                        part = min(n, left[length])
                        self.put(length, first, part, 1)
                        after.append((first, part, room - length))
                        first, n = first + part, n - part
                        left[length] -= part
                        if not left[length]:
                            lengths.remove(length)
                runs = after
            for first, n, room in runs:
                self.rooms.setdefault(room, []).append((first, n))

    def best_fit(self, s: int, n: int, capacity: int) -> None:
        """``n`` pieces of length ``s``, one after the other into the smallest room that holds one."""
        while n:
            room = min((r for r in self.rooms if r >= s), default=None)
            if room is None:
                room, runs = capacity, [(self.new(-(-n // (capacity // s))), -(-n // (capacity // s)))]
            else:
                runs = self.rooms.pop(room)
            per = room // s
            while runs and n:
                first, have = runs.pop()
                full = min(have, n // per)
                if full:
                    self.put(s, first, full * per, per)
                    self.rooms.setdefault(room - per * s, []).append((first, full))
                    n, first, have = n - full * per, first + full, have - full
                if have and n and n < per:
                    self.put(s, first, n, n)
                    self.rooms.setdefault(room - n * s, []).append((first, 1))
                    n, first, have = 0, first + 1, have - 1
                if have:
                    runs.append((first, have))
            if runs:
                self.rooms.setdefault(room, []).extend(runs)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", groups: int = GROUPS) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A null text is empty: one piece of the end id alone. Texts over ``capacity`` tokens are
    cut into pieces of that many, the last shorter. Repeated rows and ids are packed each
    on its own; other columns are left out, whatever their names; an empty table gives none.
    """
    spark = docs.sparkSession
    own = written(pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    per_task = own.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {int(r.length): int(r.n) for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = Plan(counts, capacity, groups)
    table = pd.DataFrame(sorted(plan.rows), columns=["length", "first", "pieces", "sequence", "per"])
    lengths, firsts, sequences, pers = (table[c].to_numpy(np.int64) for c in ("length", "first", "sequence", "per"))
    held = spark.sparkContext.broadcast((lengths * (1 << 45) + firsts, firsts, sequences, pers))  # a row for each run of the plan

    base = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = own.join(per_task.select("length", "task", base.alias("base")), ["length", "task"])

    @F.pandas_udf("struct<sequence_id long, place long>")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, first, sequence, per = held.value
        rank = rank.to_numpy(np.int64)
        at = np.searchsorted(keys, length.to_numpy(np.int64) * (1 << 45) + rank, "right") - 1
        nth = rank - first[at]
        return pd.DataFrame({"sequence_id": sequence[at] + nth // per[at], "place": at * np.int64(1 << 20) + nth % per[at]})

    out = ranked.withColumn("_to", placed("length", F.col("base") + F.col("rank")))
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # a sequence holds at most ``capacity`` pieces
    return out.select(id_col, "piece", "start", "length", "ids_crc32", "_to.*").select(
        id_col, "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset")
    )
