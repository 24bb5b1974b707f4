"""Token ids in binary shards, with a minimal perfect hash index from document keys to shard offsets.

A shard is one row of a Parquet data set: (shard, ids BINARY), the ids of consecutive documents in ascending doc_id order,
little-endian, 2 bytes each where the vocabulary allows it and 4 otherwise. The index is a second data set with one row
for each bucket of hashed keys: displacement seeds, and for each slot a stored fingerprint of its key, the shard, and the
offset and number of ids there. A lookup hashes a key, goes to its bucket, reads one seed and one slot, compares the
fingerprint, and slices the shard: constant time, whatever the number of documents. Buckets lie in folders of a few, and a
third data set names the file of each range of shards, so that get() opens the folder of a key's bucket and the one file of
its shard, however many there are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whisperlake.llm.common import slices, small_batches, texts
from whisperlake.llm.tokens import encoder
from whisperlake.plans.scratch import shared_dir, written

#: A shard's number is that of its range of keys, then its place in the range in so many bits.
PLACE_BITS = 20
#: Buckets of a folder of the index; ranges of a folder of the file names.
PART_BUCKETS, PART_RANGES = 16, 4096
SLOT = np.dtype([("print", "<u4"), ("shard", "<u8"), ("start", "<u8"), ("count", "<u8")])


def mix(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """64-bit finaliser of keys and a seed, for signed or unsigned longs."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + (np.asarray(seed).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


PRINT_SEED, GROUP_SEED = 1 << 40, 1 << 41


def perfect_hash(keys: np.ndarray, per_group: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Hash and displace for distinct keys: (seed of each group, slot of each key); slots are 0..n-1, each once."""
    n = len(keys)
    groups = max(1, -(-n // per_group))
    group = (mix(keys, GROUP_SEED) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=groups))
    sizes = np.diff(np.concatenate([[0], ends]))
    seeds, slots, taken = np.zeros(groups, np.uint32), np.empty(n, np.int64), np.zeros(n, bool)
    for g in np.argsort(-sizes, kind="stable").tolist():
        if not sizes[g]:
            break
        members = order[ends[g] - sizes[g] : ends[g]]
        own, seed = keys[members], 0
        while True:  # seeds are tried 64 at a time
            tried = np.arange(seed, seed + 64)
            at = (mix(own[None, :], tried[:, None]) % np.uint64(n)).astype(np.int64)
            good = ~taken[at].any(axis=1)
            if len(own) > 1:
                s = np.sort(at, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
            if good.any():
                k = int(good.argmax())
                seeds[g], slots[members] = seed + k, at[k]
                taken[at[k]] = True
                break
            seed += 64
    return seeds, slots


def lookup(keys: np.ndarray, seeds: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Position in ``slots`` of each key, or -1 where the stored fingerprint is not the key's."""
    if not len(slots):
        return np.full(len(keys), -1)
    group = (mix(keys, GROUP_SEED) % np.uint64(len(seeds))).astype(np.int64)
    at = (mix(keys, seeds[group]) % np.uint64(len(slots))).astype(np.int64)
    return np.where(slots["print"][at] == (mix(keys, PRINT_SEED) >> np.uint64(32)).astype(np.uint32), at, -1)


class TokenStore:
    """The data sets under ``path``; ``buckets`` is the number of index buckets."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, width: int):
        self.spark, self.path, self.buckets, self.width = spark, path, buckets, width

    @property
    def shards(self) -> DataFrame:
        return self.spark.read.schema("shard long, ids binary").parquet(f"{self.path}/ids")

    @property
    def index(self) -> DataFrame:
        return self.spark.read.schema("bucket long, seeds binary, slots binary, part long").parquet(f"{self.path}/index")

    def get(self, keys: list[int]) -> DataFrame:
        """(doc_id, ids array<long>) of those of some keys that the index holds: only the folders of their buckets, of the names of their ranges, and the files of their shards are read.

        The keys, and their buckets' rows, are held at once: for many, locate() is meant.
        """
        asked = self.spark.createDataFrame([(k,) for k in dict.fromkeys(keys) if k is not None], "doc_id long").withColumn("bucket", _bucket(self.buckets)).collect()
        if not asked:
            return self.spark.createDataFrame([], "doc_id long, ids array<long>")
        buckets = sorted({r["bucket"] for r in asked})
        rows = self.index.where(F.col("part").isin(sorted({b // PART_BUCKETS for b in buckets})) & F.col("bucket").isin(buckets)).collect()
        held = {r["bucket"]: (np.frombuffer(r["seeds"], np.uint32), np.frombuffer(r["slots"], SLOT)) for r in rows}
        places: dict[int, list[tuple[int, int, int]]] = {}
        for r in asked:
            if r["bucket"] in held:
                seeds, slots = held[r["bucket"]]
                at = int(lookup(np.array([r["doc_id"]]), seeds, slots)[0])
                if at >= 0:
                    places.setdefault(int(slots["shard"][at]), []).append((r["doc_id"], int(slots["start"][at]), int(slots["count"][at])))
        if not places:
            return self.spark.createDataFrame([], "doc_id long, ids array<long>")
        ranges = sorted({s >> PLACE_BITS for s in places})
        names = self.spark.read.schema("range long, file string, part long").parquet(f"{self.path}/files")
        files = [r["file"] for r in names.where(F.col("part").isin(sorted({k // PART_RANGES for k in ranges})) & F.col("range").isin(ranges)).collect()]
        width = self.width

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard, raw in zip(b.column("shard").to_pylist(), b.column("ids").to_pylist()):
                    own, ids = places.get(shard, []), np.frombuffer(raw, f"<u{width}")
                    lists = [ids[a : a + n].astype(np.int64) for _, a, n in own]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in own], pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "ids"])

        some = self.spark.read.schema("shard long, ids binary").parquet(*(f"{self.path}/ids/{f}" for f in files))
        return some.where(F.col("shard").isin(sorted(places))).mapInArrow(cut, "doc_id long, ids array<long>")

    def locate(self, keys: DataFrame) -> DataFrame:
        """(doc_id, shard, offset, count) for the distinct keys of ``keys`` that the index holds, one row each."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            own = left.column("doc_id").to_numpy()
            if right.num_rows:
                slots = np.frombuffer(right.column("slots")[0].as_py(), SLOT)
                at = lookup(own, np.frombuffer(right.column("seeds")[0].as_py(), np.uint32), slots)
            else:
                slots, at = np.zeros(0, SLOT), np.full(len(own), -1)
            own, s = own[at >= 0], slots[at[at >= 0]]
            return pa.table({"doc_id": own, "shard": s["shard"].astype(np.int64), "offset": s["start"].astype(np.int64), "count": s["count"].astype(np.int64)})

        asked = keys.select("doc_id").where("doc_id is not null").distinct().withColumn("bucket", _bucket(self.buckets))
        return asked.groupBy("bucket").cogroup(self.index.groupBy("bucket")).applyInArrow(run, "doc_id long, shard long, offset long, count long")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets))


def write_tokens(docs: DataFrame, vocabulary: str, path: str | None = None, range_bytes: int = 32_000_000, shard_ids: int = 2_000_000, bucket_keys: int = 20_000, end_id: int = 0) -> TokenStore:
    """Encode every text (null: empty) with the end id and write shards and index.

    Rows with one doc_id are stored one after the other, by text, and the index has their ids as one entry: the key's
    whole run. A null doc_id sorts first and is stored, but has no entry. An empty table gives an empty store. A task
    writes a range of keys of about ``range_bytes`` of text, as shards of about ``shard_ids`` ids or one longer text; rows
    that repeat a doc_id stay in one shard, so that their run is one slice.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/tokens-{spark.sparkContext.applicationId}-{id(docs)}-{np.random.default_rng().integers(1 << 62)}"
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("doc_id").alias("n")).first()
    ranges, buckets = max(1, round((size["b"] or 0) / range_bytes)), max(1, -(-size["n"] // bucket_keys))
    small_batches(spark)
    width = 2 if vocabulary_size(vocabulary) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << PLACE_BITS
        encode, parts, docs_, counts_ = encoder(vocabulary), [], [], []

        def full() -> pa.RecordBatch:
            one = lambda x, kind: pa.array([x], kind)
            return pa.RecordBatch.from_arrays([one(shard, pa.int64()), one(b"".join(parts), pa.binary()), one(docs_, pa.list_(pa.int64())), one(np.concatenate(counts_), pa.list_(pa.int64()))], ["shard", "ids", "docs", "counts"])

        for b in (s for batch in batches for s in slices([batch])):
            ids, counts = encode(b.column("text"))
            keys, ends = b.column("doc_id").to_pylist(), np.cumsum(counts)
            raw = np.insert(ids, ends, end_id).astype(f"<u{width}")
            counts, ends = counts + 1, ends + np.arange(1, len(counts) + 1)
            big = sum(map(len, parts)) >= width * shard_ids
            # rows of the last key go with it, and the first new key begins a new shard
            at = next((k for k, key in enumerate(keys) if key != docs_[-1]), len(keys)) if big else 0
            for lo, hi in ((0, at), (at, len(keys))):
                if big and lo == at < hi:
                    yield full()
                    shard, parts, docs_, counts_, big = shard + 1, [], [], [], False
                if lo < hi:
                    parts.append(raw[int(ends[lo - 1]) if lo else 0 : int(ends[hi - 1])].tobytes())
                    docs_ += keys[lo:hi]
                    counts_.append(counts[lo:hi])
        if docs_:
            yield full()

    ordered = texts(docs).repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(run, "shard long, ids binary, docs array<long>, counts array<long>")
    # one file for a range; the keys' places are metadata beside the ids and are read without them
    encoded.write.option("compression", "zstd").parquet(f"{path}/ids")
    places = spark.read.schema("shard long, docs array<long>, counts array<long>").parquet(f"{path}/ids")

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, keys, counts in zip(*(b.column(c).to_pylist() for c in ("shard", "docs", "counts"))):
                keys, counts = np.array([np.iinfo(np.int64).min if k is None else k for k in keys], np.int64), np.array(counts, np.int64)
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                starts = (np.cumsum(counts) - counts)[first]
                some = keys[first] != np.iinfo(np.int64).min
                cols = keys[first][some], np.full(some.sum(), shard, np.int64), starts[some], np.add.reduceat(counts, first)[some]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["doc_id", "shard", "offset", "count"])

    def index(table: pa.Table) -> pa.Table:
        keys = table.column("doc_id").to_numpy()
        seeds, at = perfect_hash(keys)
        slots = np.zeros(len(keys), SLOT)
        slots["print"][at] = (mix(keys, PRINT_SEED) >> np.uint64(32)).astype(np.uint32)
        for name, column in (("shard", "shard"), ("start", "offset"), ("count", "count")):
            slots[name][at] = table.column(column).to_numpy()
        return pa.table({"part": table.column("part")[:1], "bucket": table.column("bucket")[:1], "seeds": pa.array([seeds.tobytes()], pa.binary()), "slots": pa.array([slots.tobytes()], pa.binary())})

    entries = places.mapInArrow(flat, "doc_id long, shard long, offset long, count long").withColumn("bucket", _bucket(buckets))
    entries = entries.withColumn("part", F.floor(F.col("bucket") / PART_BUCKETS)).repartition("part")
    entries.groupBy("part", "bucket").applyInArrow(index, "part long, bucket long, seeds binary, slots binary").write.partitionBy("part").parquet(f"{path}/index")
    # the file of each range, a range being what one task wrote
    files = spark.read.schema("shard long").parquet(f"{path}/ids").select(F.shiftright("shard", PLACE_BITS).alias("range"), F.col("_metadata.file_name").alias("file")).distinct()
    files.withColumn("part", F.floor(F.col("range") / PART_RANGES)).repartition("part").write.partitionBy("part").parquet(f"{path}/files")
    return TokenStore(spark, path, buckets, width)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def digests(store: TokenStore, keys: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ``keys`` from the files: start counts all ids before the document's."""
    width = store.width
    sizes = store.shards.select("shard", (F.octet_length("ids") / width).cast("long").alias("n"), F.shiftright("shard", PLACE_BITS).alias("block"))
    sizes = written(sizes, "sizes")
    # running sums within ranges, of ranges within PART_RANGES of them, and over these, of which there are few
    before = lambda order, *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("n")).withColumn("part", F.floor(F.col("block") / PART_RANGES))
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n")).select("part", before("part").alias("of_parts"))
    blocks = blocks.select("block", "part", before("block", "part").alias("of_blocks")).join(parts, "part")
    bases = sizes.withColumn("inside", before("shard", "block")).join(blocks, "block").select("shard", (F.col("inside") + F.col("of_blocks") + F.col("of_parts")).alias("base"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("doc_id", "start", "n_tokens", "ids_crc32")})
        payload, base = right.column("ids")[0].as_buffer(), right.column("base")[0].as_py()
        ids = np.frombuffer(payload, f"<u{width}")
        at, n = left.column("offset").to_numpy(), left.column("count").to_numpy()
        crc = [zlib.crc32(ids[a : a + c].astype("<u4").tobytes()) for a, c in zip(at.tolist(), n.tolist())]
        return pa.table({"doc_id": left.column("doc_id"), "start": pa.array(at + base), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())})

    found = store.locate(keys)
    return found.groupBy("shard").cogroup(store.shards.join(bases, "shard").groupBy("shard")).applyInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
