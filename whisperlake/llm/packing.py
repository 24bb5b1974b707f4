"""First-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whisperlake.llm.binary import vocabulary_size
from whisperlake.llm.common import slices, small_batches, texts
from whisperlake.llm.tokens import encoder
from whisperlake.plans.scratch import written

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"
PLACES = "array<struct<doc_id: bigint, start: bigint, length: bigint, offset: bigint, doc_tokens: bigint>>"

PLACED = ["doc_id", "start", "length", "offset", "doc_tokens"]


class Tournament:
    """Bins in the order they were opened; ``fit`` finds the first with room by descending a tree of maxima."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.size)

    def fit(self, length: int) -> int:
        most, k = self.most, 1
        while k < self.size:
            k = 2 * k if most[2 * k] >= length else 2 * k + 1
        at, room = k - self.size, most[k] - length
        most[k] = room
        while k > 1:
            k //= 2
            room = max(most[2 * k], most[2 * k + 1])
            if most[k] == room:
                break
            most[k] = room
        return at


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length: its bin and its offset there. Ties keep their order."""
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths >= capacity).sum())
    bins, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins[order[:full]] = np.arange(full)
    tree, used = Tournament(max(1, len(lengths) - full), capacity), {}
    for k, n in zip(order[full:].tolist(), lengths[order[full:]].tolist()):
        at = tree.fit(n)
        bins[k], offset[k] = full + at, used.get(at, 0)
        used[at] = used.get(at, 0) + n
    return bins, offset


def id_type(vocabulary: str, end_id: int) -> str:
    """numpy type of stored ids: 2 bytes if all fit."""
    return "<u2" if max(vocabulary_size(vocabulary), end_id + 1) <= 1 << 16 else "<u4"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Every document's ids with the end id, cut every ``capacity`` ids: PIECES, the ids in 4 bytes each where the vocabulary needs it, else in 2."""

    kind = id_type(vocabulary, end_id)
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for b in (s for batch in batches for s in slices([batch])):
            ids, counts = encode(b.column("text"))
            cols: tuple[list, ...] = ([], [], [], [], [])
            at = 0
            for doc, n in zip(b.column("doc_id").to_pylist(), counts.tolist()):
                raw = np.append(ids[at : at + n], end_id).astype(kind).tobytes()
                at += n
                for s in range(0, n + 1, capacity):
                    size = min(capacity, n + 1 - s)
                    for c, v in zip(cols, (doc, s, size, raw[width * s : width * (s + size)], n + 1)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(cols)], ["doc_id", "start", "length", "ids", "doc_tokens"])

    small_batches(docs.sparkSession)
    return texts(docs).mapInArrow(run, PIECES)


def sequences(docs: DataFrame, vocabulary: str, capacity: int = 1024, group_tokens: int = 8_000_000, end_id: int = 0) -> DataFrame:
    """(sequence_id, ids, used, pieces): ``capacity`` ids padded with the end id, how many are used, and what they are.

    Groups are drawn from a row's number in its scan, never from its key, so that no key makes a large one; each holds
    about ``group_tokens`` ids. A null text counts as empty and has the end id alone. Repeated rows are packed as often as
    they occur, rows with a null doc_id too; very long texts are cut like any other; an empty table gives no rows; columns other than doc_id and text are not read. Ties go by doc_id, row and
    start, so that a group always packs alike.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = max(1, round(size / 2.5 / group_tokens))
    kind = id_type(vocabulary, end_id)
    places = pa.list_(pa.struct([(c, pa.int64()) for c in PLACED]))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "row", "start")])
        bins, offset = first_fit_decreasing(table.column("length").to_numpy(), capacity)
        first = table.column("part")[0].as_py() << 32 if table.num_rows else 0
        order = np.lexsort((offset, bins))
        table, bins = table.take(pa.array(order)), bins[order]
        table = table.append_column("offset", pa.array(offset[order]))
        edge = np.append(np.flatnonzero(np.diff(bins, prepend=-1)), len(bins))
        out: list[tuple] = []
        for a, z in zip(edge.tolist(), edge[1:].tolist()):
            t = table.slice(a, z - a)
            raw = b"".join(t.column("ids").to_pylist())
            used = len(raw) // np.dtype(kind).itemsize
            out.append((first + int(bins[a]), raw + np.full(capacity - used, end_id, kind).tobytes(), used, t.select(PLACED).to_pylist()))
        return pa.table([pa.array([x[k] for x in out], c) for k, c in enumerate((pa.int64(), pa.binary(), pa.int64(), places))], ["sequence_id", "ids", "used", "pieces"])

    cut = pieces(docs, vocabulary, capacity, end_id).withColumn("row", F.monotonically_increasing_id())
    part = F.pmod(F.xxhash64(F.col("row") - (F.col("start") / capacity).cast("long"), F.lit("packing")), F.lit(groups))
    return cut.withColumn("part", part).groupBy("part").applyInArrow(run, f"sequence_id long, ids binary, used long, pieces {PLACES}")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, group_tokens: int = 8_000_000, end_id: int = 0) -> DataFrame:
    """One row for each piece with its sequence_id, offset and checksum, taken from the sequences as they were written."""
    kind = id_type(vocabulary, end_id)
    made = written(sequences(docs, vocabulary, capacity, group_tokens, end_id), "sequences")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for s, raw, held in zip(*(b.column(c).to_pylist() for c in ("sequence_id", "ids", "pieces"))):
                ids = np.frombuffer(raw, kind).astype("<u4")
                for p in held:
                    at = p["offset"]
                    rows.append((p["doc_id"], p["start"], p["length"], zlib.crc32(ids[at : at + p["length"]].tobytes()), p["doc_tokens"], s, at))
            cols = [*zip(*rows)] if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [*PLACED[:3], "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return made.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
