"""Best-fit packing of documents into training sequences, in bounded space.

Each task packs the pieces of its own rows online: a fixed number of bins is open, in a bitset keyed by
free space; a piece goes to the open bin that it fits best, and when none fits and no more may open, the
fullest closes. The pieces of bins that are still open when a task ends are packed once more, by the same
method and longest first, dealt over as many tasks as their number asks for; so the partly filled sequences
do not grow with the number of tasks. No text and no token id is shuffled, only the left-over pieces' digests.

A document is its ids and then the end id. Only a document longer than a sequence is cut, into pieces of
the full length; its last piece may be shorter.

Defined results: a null or empty text is the end id alone; rows with equal or null ids are separate
documents; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import small_batches
from quillon.llm.word_tokens import WORD_BPE, tokenizer
from quillon.session import checkpointed

SEQUENCE = 2048
END = b"\x00\x00\x00\x00"
#: Bins that are open at one time, in the pass over the documents and in that over what it leaves.
OPEN_BINS = 1024
OPEN_BINS_LEFT = 1 << 15
#: Left-over pieces that one task packs in the second pass, on average.
LEFT_PER_TASK = 100_000
#: Rows that a task holds before it gives away those of closed bins.
FLUSH = 100_000
#: The parts of a sequence's number: whether the second pass made it, the task, the bin within the task.
_TASK_BITS = 36
_SECOND = 1 << 62

COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


class OpenBins:
    """A bounded set of open bins; place() says where an item goes."""

    def __init__(self, size: int = SEQUENCE, most: int = OPEN_BINS):
        self.size, self.most = size, most
        self.free = 0  # bit f is set if some open bin has f free
        self.by_free: dict[int, deque[int]] = defaultdict(deque)
        self.count = self.named = 0

    def _take(self, f: int) -> int:
        queue = self.by_free[f]
        found = queue.popleft()
        if not queue:
            self.free ^= 1 << f
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for an item of 1 to size units; the tightest open bin that it fits, or a new one."""
        above = self.free >> length
        if above:
            f = length + (above & -above).bit_length() - 1
            found = self._take(f)
        else:
            if length < self.size and self.count >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
                self.count -= 1
            found, f = self.named, self.size
            self.named += 1
            self.count += 1
        left = f - length
        if left:
            self.free |= 1 << left
            self.by_free[left].append(found)
        else:
            self.count -= 1
        return found, self.size - f

    def still_open(self) -> set[int]:
        return {b for queue in self.by_free.values() for b in queue}


def _first_pass(docs: DataFrame, size: int, most: int, path: str) -> DataFrame:
    def run(batches):
        bins, encode = OpenBins(size, most), tokenizer(path).encode
        base = TaskContext.get().partitionId() << _TASK_BITS
        rows: list[tuple] = []
        width, held = 4 * size, 0

        def table(part, opened):
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array([r[k] for r in part], kind) for k, kind in enumerate(kinds, 1)]
            keys = pa.array([r[0] for r in part], key_type)
            state = pa.array([r[5] - base in opened for r in part], pa.bool_())
            return pa.RecordBatch.from_arrays([keys, *columns, state], names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "open"])

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.schema.field(0).type
            for key, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                ids += END
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    n = len(part) // 4
                    where, offset = bins.place(n)
                    rows.append((key, k, at // 4, n, zlib.crc32(part), base + where, offset))
            if len(rows) > FLUSH + 2 * held:  # rows of bins that are still open wait; each look at them is paid for by as many new rows
                opened = bins.still_open()
                done = [r for r in rows if r[5] - base not in opened]
                rows = [r for r in rows if r[5] - base in opened]
                held = len(rows)
                yield table(done, set())
        yield table(rows, bins.still_open())

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, bin long, offset long, open boolean")


def _second_pass(left: DataFrame, size: int, most: int) -> DataFrame:
    """Final rows for the pieces of bins that no task closed, the long ones first."""
    key = left.schema["doc_id"].dataType.simpleString()

    def run(group, table):
        bins, order = OpenBins(size, most), table.sort_by([("length", "descending"), ("bin", "ascending"), ("offset", "ascending")])
        placed = [bins.place(n) for n in order.column("length").to_pylist()]
        base = _SECOND | group[0].as_py() << _TASK_BITS
        numbers = [pa.array([base + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
        return pa.table([*[order.column(c) for c in COLUMNS], *numbers], names=[*COLUMNS, "sequence_id", "offset"])

    return left.groupBy("dealt").applyInArrow(run, f"doc_id {key}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, size: int = SEQUENCE, most: int = OPEN_BINS, most_left: int = OPEN_BINS_LEFT, path: str = WORD_BPE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for every piece of every row of docs."""
    small_batches(docs.sparkSession)
    pieces = checkpointed(_first_pass(docs, size, most, path))  # digests of the pieces, not their ids
    left = pieces.filter("open")
    groups = max(1, -(-left.count() // LEFT_PER_TASK))
    closed = pieces.filter("NOT open").select(*COLUMNS, F.col("bin").alias("sequence_id"), "offset")
    return closed.unionAll(_second_pass(left.withColumn("dealt", F.pmod(F.xxhash64("bin", "offset"), F.lit(groups)).cast("int")), size, most_left))
