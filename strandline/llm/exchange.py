"""Which of very many strings occur twice or more, found over all documents in Spark tasks.

Documents are first packed into groups of about group_bytes of text, a row each, in the shared folder; a group has a number of its own, so nothing depends on ids
or texts being distinct. Every step reads groups, and the answers go back to groups.

A map task reduces the strings of a group to distinct ones, each sent once however often the group has it; those that a group has twice need no answer. So
a string that a third of all documents share costs one entry a group, not one a document. An entry has a 64-bit fingerprint, which orders it, and 32 more
bits of an independent one, without which it is not taken for equal. Blocks hold the entries of a bucket, a range of fingerprints. A bucket gets about
bucket_bytes of text however large the corpus is; a task sorts several of them, one at a time, so its memory follows the bucket. The answer to a group
lists the numbers of those of its distinct strings that other groups have too.

Between Spark and Python go Arrow batches of about batch_bytes, or of one row that is larger: a batch counts several times, in buffers of the JVM beside its heap and in
Python, and by default would hold all groups of a file, or all blocks of some groups.

Two unequal strings are taken for equal with probability 2**-96 a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from strandline.llm import bytescan
from strandline.llm.storage import materialize, setting

GROUP_BYTES, BUCKET_BYTES, BATCH_BYTES = 4 << 20, 8 << 20, 4 << 20
#: Buckets that one task sorts one after another, and groups whose entries are dealt into blocks together.
TASK_BUCKETS, BLOCK_GROUPS = 4, 4
#: Bytes of text whose groups one task joins with their answers.
JOIN_BYTES = 64 << 20
#: Bytes of an entry in a block.
ENTRY_BYTES = 12
BLOCK_SCHEMA = "bucket int, groups binary, counts binary, firsts binary, hashes binary, checks binary"
ANSWER_SCHEMA = "part int, groups binary, counts binary, numbers binary"

#: Of a group's texts: fingerprints and checks of its strings, in text order.
Kernel = Callable[..., tuple[np.ndarray, np.ndarray]]


def in_small_batches(df: DataFrame, label: str) -> DataFrame:
    """materialize(), with Arrow batches of about BATCH_BYTES."""
    with setting(df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)):
        return materialize(df, label)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


# ---- groups


def _pack(batches, group_bytes: int):
    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def flush():
        nonlocal number, held, size
        rows = pa.concat_arrays(held)
        out = pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], ["grp", "rows"])
        number, held, size = number + 1, [], 0
        return out

    for batch in batches:
        rows = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
        for part in bytescan.texts(batch.column("text"), group_bytes // 4):
            held.append(rows.slice(part.rows.start, len(part)))
            size += len(part.data)
            if size >= group_bytes:
                yield flush()
    if held:
        yield flush()


def packed(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(grp, rows): documents in groups, in the shared folder. docs has a column text; a text beyond group_bytes has a group of its own."""
    schema = StructType([StructField("grp", LongType()), StructField("rows", ArrayType(docs.schema))])
    return in_small_batches(docs.mapInArrow(partial(_pack, group_bytes=group_bytes), schema), "groups")


def rows_of(batch: pa.RecordBatch, k: int) -> pa.StructArray:
    """The documents of the k-th group of a batch of groups."""
    return batch.column("rows").slice(k, 1).flatten()


# ---- strings that occur twice


class Distinct:
    """The strings of a group made distinct: their fingerprints in order, and which of them the group has twice."""

    def __init__(self, hashes: np.ndarray, checks: np.ndarray):
        order = np.argsort(hashes)
        new = self._edges(hashes[order], checks[order])
        if new is None:
            order = np.lexsort((checks, hashes))
            ranked, more = hashes[order], checks[order]
            new = np.ones(len(order), bool)
            new[1:] = (ranked[1:] != ranked[:-1]) | (more[1:] != more[:-1])
        self.order, first = order, np.flatnonzero(new)
        self.hashes, self.checks = hashes[order[first]], checks[order[first]]
        self.sizes = np.diff(np.append(first, len(order)))

    @staticmethod
    def _edges(ranked: np.ndarray, more: np.ndarray) -> np.ndarray | None:
        """Where another string begins, or None if two with equal fingerprints differ."""
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        return None if (more[1:] != more[:-1])[~new[1:]].any() else new

    def twice(self, numbers: list[np.ndarray]) -> np.ndarray:
        """Which of the group's strings, in text order, occur twice. numbers: of distinct strings that other groups have too."""
        found = self.sizes > 1
        for x in numbers:
            found[x] = True
        out = np.empty(len(self.order), bool)
        out[self.order] = np.repeat(found, self.sizes)
        return out


def answers(value) -> list[np.ndarray]:
    """The numbers in a value of repeated(), or in a list of them; none for null."""
    return [np.frombuffer(x, "<u4") for x in ([value] if isinstance(value, bytes) else value or ())]


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges, so they ascend with the fingerprints."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _entries(batches, kernel: Kernel, columns: list[str], buckets: int, share: tuple[int, int], batch_bytes: int = BATCH_BYTES):
    held: list[tuple] = []

    def flush():
        """The blocks of the groups held, one range of buckets after the other."""
        steps = min(buckets, -(-ENTRY_BYTES * sum(len(x[1]) for x in held) // batch_bytes))
        edges = np.arange(steps + 1) * buckets // steps
        cuts = [np.searchsorted(_bucket_of(x[2], buckets), edges) for x in held]
        for k in range(steps):
            own = [(x[0], *(column[cut[k] : cut[k + 1]] for column in x[1:])) for x, cut in zip(held, cuts, strict=True)]
            if any(len(x[1]) for x in own):
                yield blocks(own)

    def blocks(held):
        group = np.repeat(np.arange(len(held)), [len(x[1]) for x in held])
        number = np.concatenate([x[1] for x in held])
        hashes, checks = (np.concatenate([x[k] for x in held]) for k in (2, 3))
        bucket = _bucket_of(hashes, buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
        bucket, group, number, hashes, checks = bucket[order], group[order], number[order], hashes[order], checks[order]
        new = np.ones(len(order), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (group[1:] != group[:-1])
        run = np.flatnonzero(new)
        sizes = np.diff(np.append(run, len(order))).astype("<u4")
        names, firsts = np.array([x[0] for x in held], "<i8")[group[run]], number[run].astype("<u4")
        present, begin = np.unique(bucket[run], return_index=True)
        edges, ends = np.append(begin, len(run)), np.append(run, len(order))
        rows = [(int(b), names[i:j].tobytes(), sizes[i:j].tobytes(), firsts[i:j].tobytes(), hashes[ends[i] : ends[j]].tobytes(), checks[ends[i] : ends[j]].tobytes()) for b, i, j in zip(present, edges[:-1], edges[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 6))], ["bucket", "groups", "counts", "firsts", "hashes", "checks"])

    for batch in batches:
        for k in range(batch.num_rows):
            strings = Distinct(*kernel(rows_of(batch, k).field("text"), *(batch.column(c)[k].as_py() for c in columns)))
            own = _bucket_of(strings.hashes, buckets) % share[1] == share[0]
            if own.any():
                held.append((batch.column("grp")[k].as_py(), np.flatnonzero(own).astype("<u4"), strings.hashes[own].astype("<u8"), strings.checks[own].astype("<u4")))
            del strings, own
            if len(held) == BLOCK_GROUPS:
                yield from flush()
                held = []
    if held:
        yield from flush()


def _bucketwise(batches) -> Iterator[tuple[int, list]]:
    """The rows of one bucket after the other."""
    rows = ((batch, k) for batch in batches for k in range(batch.num_rows))
    for bucket, own in groupby(rows, lambda x: x[0].column(0)[x[1]].as_py()):
        yield bucket, [tuple(batch.column(c)[k].as_py() for c in range(1, 6)) for batch, k in own]


def _shared(batches, parts: int):
    """The entries of each bucket that several groups have, told to these groups."""
    for _, rows in _bucketwise(batches):
        names, counts, firsts, hashes, checks = (np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in enumerate(("<i8", "<u4", "<u4", "<u8", "<u4")))
        del rows
        order = np.argsort(hashes)
        if Distinct._edges(hashes[order], checks[order]) is None:
            order = np.lexsort((checks, hashes))
        ranked, more = hashes[order], checks[order]
        same = (ranked[1:] == ranked[:-1]) & (more[1:] == more[:-1])
        several = np.zeros(len(order), bool)
        several[1:] |= same
        several[:-1] |= same
        at = np.sort(order[several])
        if not len(at):
            continue
        counts = counts.astype(np.int64)
        begins = np.cumsum(counts) - counts
        run = np.searchsorted(begins, at, side="right") - 1
        names, numbers = names[run], (at - begins[run] + firsts[run]).astype("<u4")
        part = (bytescan.mix(names.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((names, part))
        names, numbers, part = names[order], numbers[order], part[order]
        new = np.ones(len(order), bool)
        new[1:] = names[1:] != names[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(order))).astype("<u4")
        present, begin = np.unique(part[first], return_index=True)
        edges, ends = np.append(begin, len(first)), np.append(first, len(order))
        out = [(names[first[i:j]].tobytes(), sizes[i:j].tobytes(), numbers[ends[i] : ends[j]].tobytes()) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(present.astype(np.int32)), *(pa.array([r[k] for r in out], pa.binary()) for k in range(3))], ["part", "groups", "counts", "numbers"])


def _merged(batches):
    """Of a partition's answers: all that goes to a group in one value."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for names, counts, numbers in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
            ends = np.cumsum(np.frombuffer(counts, "<u4").astype(np.int64)) * 4
            for name, a, b in zip(np.frombuffer(names, "<i8").tolist(), (ends - 4 * np.frombuffer(counts, "<u4")).tolist(), ends.tolist(), strict=True):
                held.setdefault(name, []).append(numbers[a:b])
    for name, x in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(x)], pa.binary())], ["grp", "numbers"])


def repeated(groups: DataFrame, kernel: Kernel, total: int, columns: list[str] | None = None, share: tuple[int, int] = (0, 1), bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(grp, numbers), in the shared folder, of every group with a string that another group has too; Distinct.twice() reads numbers. kernel gets a group's texts and its columns; total: bytes
    of all texts; share: (k, n) looks at the k-th of n shares of the buckets."""
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(-(-total // bucket_bytes), tasks * share[1])
    parts = max(tasks, -(-buckets // (TASK_BUCKETS * share[1])))
    blocks = groups.select("grp", "rows", *(columns or [])).mapInArrow(partial(_entries, kernel=kernel, columns=columns or [], buckets=buckets, share=share), BLOCK_SCHEMA)
    own = blocks.repartitionById(parts, (F.col("bucket") / share[1]).cast("int") % parts).sortWithinPartitions("bucket")
    told = own.mapInArrow(partial(_shared, parts=parts), ANSWER_SCHEMA).repartitionById(parts, F.col("part")).mapInArrow(_merged, "grp long, numbers binary")
    return in_small_batches(told, "answers")  # which frees the entries


def answered(groups: DataFrame, found: list[DataFrame], total: int) -> DataFrame:
    """Groups with numbers, a list of their values in found (tables of repeated()), or null. The number of tasks follows total, whatever spark.sql.shuffle.partitions is, since
    the answers that a task holds can't be spilled."""
    parts = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // JOIN_BYTES))
    numbers = reduce(DataFrame.union, found).repartition(parts, "grp").groupBy("grp").agg(F.collect_list("numbers").alias("numbers"))
    return groups.repartition(parts, "grp").join(numbers.hint("shuffle_hash"), "grp", "left")
