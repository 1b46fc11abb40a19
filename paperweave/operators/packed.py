"""Pairs of whole numbers that meet in groups, shuffled as a few bytes each instead of as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of an item that one row counts; an item of more has its pairs dealt over lanes.
LANE = 512
#: Pairs, and bytes of them, that a task holds at once.
HELD, BYTES = 2_000_000, 2_000_000


def _codec():
    """varints, numbers and chunks; functions of a function reach the tasks by value, where this package need not be installed."""
    import numpy as np

    def varints(values):
        """Numbers (uint64) as bytes of seven bits, the last of each below 128, and how many bytes each takes."""
        size = np.ones(len(values), np.int64)
        for k in range(1, 10):
            size += values >= np.uint64(1 << 7 * k)
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint8)
        for k in range(int(size.max(initial=0))):
            at = np.flatnonzero(size > k)
            low = (values[at] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8)
            out[first[at] + k] = low | np.where(size[at] > k + 1, 128, 0).astype(np.uint8)
        return out, size

    def numbers(data):
        """The numbers of varints, and how many of them end before each place of the bytes."""
        last = data < 128
        ends = np.flatnonzero(last)
        starts = np.concatenate((np.zeros(1, np.int64), ends + 1))[:-1]
        size = ends - starts + 1
        out = np.zeros(len(ends), np.uint64)
        for k in range(int(size.max(initial=0))):
            at = np.flatnonzero(size > k)
            out[at] |= (data[starts[at] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
        return out, np.concatenate((np.zeros(1, np.int64), np.cumsum(last)))

    def chunks(costs, most):
        """(from, to) of pieces in a row that cost about `most` each."""
        total = np.cumsum(costs)
        at = 0
        while at < len(costs):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
            yield at, to
            at = to

    return varints, numbers, chunks


def tails(lists: DataFrame) -> DataFrame:
    """(a, na, lane, tail) of groups (items, degrees), both in item order: for each item those behind it in its group.

    A tail holds steps from one item to the next and degrees. It is a piece of
    its group's bytes, which are made once.
    """
    varints, _, chunks = _codec()
    wide, held = LANE, HELD

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def told(a, na, lane, tail):
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(na.view(np.int64)), pa.array(lane, pa.int32()), tail], ["a", "na", "lane", "tail"])

        for batch in batches:
            bounds = batch.column("items").offsets.to_numpy().astype(np.int64)
            bounds -= bounds[0]
            every, degrees = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("items", "degrees"))
            many = np.diff(bounds)
            for low, high in chunks(many * (many - 1) // 2, held):
                x, n = (v[bounds[low] : bounds[high]] for v in (every, degrees))
                last = np.repeat(bounds[low + 1 : high + 1], many[low:high]) - bounds[low]
                step = np.diff(x, prepend=x[:1])
                data, size = varints(np.stack([step, n], 1).ravel())
                off = np.concatenate((np.zeros(1, np.int64), np.cumsum(size.reshape(-1, 2).sum(1))))
                left = last > np.arange(len(x)) + 1
                rows = np.flatnonzero(left & (n <= wide))
                begin, length = off[rows + 1], off[last[rows]] - off[rows + 1]
                ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(length)))
                body = data[np.repeat(begin - ends[:-1], length) + np.arange(ends[-1])]
                yield told(x[rows], n[rows], np.zeros(len(rows), np.int32), pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body)]))
                for r in np.flatnonzero(left & (n > wide)):
                    y, m = x[r + 1 : last[r]], n[r + 1 : last[r]]
                    lane = (y * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(-(-int(n[r]) // wide))
                    own = np.unique(lane)
                    cut = [varints(np.stack([np.diff(y[lane == k], prepend=x[r : r + 1]), m[lane == k]], 1).ravel())[0].tobytes() for k in own]
                    yield told(np.repeat(x[r], len(own)), np.repeat(n[r], len(own)), own.astype(np.int32), pa.array(cut, pa.binary()))

    return lists.mapInArrow(run, "a long, na long, lane int, tail binary")


def counted(rows: DataFrame) -> DataFrame:
    """(a, b, na, nb, shared) of rows (a, na, tails), each of which has all tails of an item, or of a lane of it."""
    _, numbers, chunks = _codec()
    most = BYTES

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            bounds = batch.column("tails").offsets.to_numpy().astype(np.int64)
            bounds -= bounds[0]
            held = batch.column("tails").flatten()
            at = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
            data = np.frombuffer(held.buffers()[2], np.uint8)
            a, na = (batch.column(c).to_numpy().view(np.uint64) for c in ("a", "na"))
            for low, high in chunks(np.diff(at[bounds]), most):
                places = at[bounds[low] : bounds[high] + 1]
                values, before = numbers(data[places[0] : places[-1]])
                first = before[places - places[0]] // 2
                many = np.diff(first)
                step, n = values[0::2], values[1::2]
                owner = np.repeat(np.arange(high - low), np.diff(bounds[low : high + 1]))
                # steps add up within a tail, from its item on; sums of 64 bits wrap and come right again
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(step)))
                b = total[1:] + np.repeat(a[low:high][owner] - total[first[:-1]], many)
                row = np.repeat(owner, many)
                order = np.lexsort((b.view(np.int64), row))
                b, row, n = b[order], row[order], n[order]
                new = np.flatnonzero(np.concatenate((np.ones(1, bool), (b[1:] != b[:-1]) | (row[1:] != row[:-1]))))
                shared = np.diff(np.append(new, len(b)))
                row = row[new] + low
                found = (a[row], b[new], na[row], n[new])
                yield pa.RecordBatch.from_arrays([*(pa.array(v.view(np.int64)) for v in found), pa.array(shared)], ["a", "b", "na", "nb", "shared"])

    return rows.mapInArrow(run, "a long, b long, na long, nb long, shared long")


def lists_of(item: Column, degree: Column) -> Column:
    """A group's items with their degrees, in item order."""
    return F.sort_array(F.collect_list(F.struct(item.cast("long").alias("i"), degree.cast("long").alias("n"))))
