"""Exact deduplication over a sharded cuckoo-filter index of live digests.

Every text is digested once (SHA-256, in the JVM) into a table of (doc_id,
digest).  Copies are first combined within each Arrow batch, so a text that
holds a third of all rows reaches its shard as a few rows.  Shards are hash
ranges of the digest; each runs a CuckooIndex: fingerprints in two candidate
buckets of four slots, where a hit is verified against the full digest stored
in that slot, a newer keeper replaces the live entry (delete, then insert), and
a failed insertion doubles the table and re-inserts from the stored keys.

Hits are verified against content: rows whose digest occurs twice or more (told
by a Bloom filter of fixed size) send their text to its bucket, a range of
digests sorted by digest and text, once for each task and text; a bucket holds
one text at a time and counts how many different ones a digest has.  A digest
of several is taken apart by its texts.

The decision returns to the rows by a join on the digest.  Groups above 1/1000
of all rows are at most 1000 by arithmetic and are broadcast; all other groups
are joined by shuffle and are small against a partition.

Defined results: null text equals the empty text; rows repeated with the same
doc_id are each returned, and all of those with the kept id are kept; null ids
lose against others, and where a group has no other, all its rows are kept; an
empty table gives an empty result; extra columns are not read (keep_one returns
them as they are); a text is held whole, one at a time.
"""

from __future__ import annotations

import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import KeyFilter, discard, fresh, id_text, lookup, materialise, table

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Cuckoo filter whose slots point at stored (digest, keeper, count) records."""

    def __init__(self, capacity: int = 1024):
        self.digests: list[bytes | None] = []
        self.keepers: list[int | None] = []
        self.counts: list[int] = []
        self.free: list[int] = []
        self.resizes = 0
        self._allocate(capacity)

    def _allocate(self, capacity: int) -> None:
        buckets = 1
        while buckets * SLOTS < capacity:
            buckets *= 2
        self.mask = buckets - 1
        self.prints = array.array("H", bytes(2 * buckets * SLOTS))  # 0: empty slot
        self.records = array.array("q", bytes(8 * buckets * SLOTS))

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, digest: bytes) -> int:
        mark, first, second = self._places(digest)
        prints, records, digests = self.prints, self.records, self.digests
        for bucket in (first, second):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if prints[at] == mark and digests[records[at]] == digest:
                    return at
        return -1

    def get(self, digest: bytes) -> tuple[int | None, int] | None:
        at = self._slot(digest)
        if at < 0:
            return None
        record = self.records[at]
        return self.keepers[record], self.counts[record]

    def delete(self, digest: bytes) -> bool:
        at = self._slot(digest)
        if at < 0:
            return False
        record = self.records[at]
        self.digests[record] = None
        self.free.append(record)
        self.prints[at] = 0
        return True

    def insert(self, digest: bytes, keeper: int | None, count: int) -> None:
        if self.free:
            record = self.free.pop()
            self.digests[record], self.keepers[record], self.counts[record] = digest, keeper, count
        else:
            record = len(self.digests)
            self.digests.append(digest)
            self.keepers.append(keeper)
            self.counts.append(count)
        mark, first, second = self._places(digest)
        if not self._settle(mark, first, second, record):
            self._grow()

    def _settle(self, mark: int, first: int, second: int, record: int) -> bool:
        prints, records = self.prints, self.records
        for bucket in (first, second):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not prints[at]:
                    prints[at], records[at] = mark, record
                    return True
        bucket = second
        for kick in range(MAX_KICKS):
            at = bucket * SLOTS + (kick + record) % SLOTS
            prints[at], mark = mark, prints[at]
            records[at], record = record, records[at]
            bucket = self._other(bucket, mark)
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not prints[at]:
                    prints[at], records[at] = mark, record
                    return True
        return False

    def _grow(self) -> None:
        """Double until every stored key finds a slot."""
        capacity = (self.mask + 1) * SLOTS
        while True:
            capacity *= 2
            self.resizes += 1
            self._allocate(capacity)
            if all(self._settle(*self._places(d), k) for k, d in enumerate(self.digests) if d is not None):
                return

    def absorb(self, digest: bytes, keeper: int | None, count: int) -> None:
        """One sighting: a hit that brings a larger keeper replaces the live entry."""
        at = self._slot(digest)
        if at < 0:
            self.insert(digest, keeper, count)
            return
        record = self.records[at]
        old, count = self.keepers[record], count + self.counts[record]
        if keeper is None or (old is not None and old >= keeper):
            self.counts[record] = count
        else:
            self.delete(digest)
            self.insert(digest, keeper, count)

    def live(self) -> Iterator[tuple[bytes, int | None, int]]:
        return ((d, k, n) for d, k, n in zip(self.digests, self.keepers, self.counts, strict=True) if d is not None)


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within a batch become one sighting."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by("digest", use_threads=False).aggregate([("doc_id", "max"), ("doc_id", "count", pa.compute.CountOptions(mode="all"))])
        yield from t.select(["digest", "doc_id_max", "doc_id_count"]).rename_columns(["digest", "keep_id", "group_size"]).to_batches()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for digest, keeper, count in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            index.absorb(digest, keeper, count)
    rows = [x for x in index.live() if x[2] > 1]
    for at in range(0, len(rows), 10_000):
        digests, keepers, counts = zip(*rows[at : at + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(keepers, pa.int64()), pa.array(counts, pa.int64())], ["digest", "keep_id", "group_size"])


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests with more than one text, of rows sorted by digest and text."""
    digest = text = told = None
    for batch in batches:
        out = []
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if d == digest and t != text and told != d:
                told = d
                out.append(d)
            digest, text = d, t
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["digest"])


SHARD_ROWS = 2_000_000


DIGEST_BYTES = 32


def digest_of(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, DIGEST_BYTES)


def duplicate_groups(marked: DataFrame, texts: DataFrame, total: int) -> tuple[DataFrame, DataFrame | None]:
    """(digest, keep_id, group_size, hashed: texts that occur twice or more; the same with text for digests of several texts, or None).

    marked: doc_id, digest; texts: doc_id, text; of the same rows.
    """
    spark = marked.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SHARD_ROWS + 1)
    kind = "digest binary, keep_id long, group_size long"
    found = marked.select("doc_id", "digest").mapInArrow(_combine, kind).repartition(shards, "digest").mapInArrow(_index, kind)
    groups = materialise(found.withColumn("hashed", F.xxhash64("digest")), "dedup-groups")
    digest = digest_of(F.col("text"))
    # one Python pass: the filter, and a text once for each task that meets it
    sighted, _ = KeyFilter(groups, "hashed").split(texts.select(digest.alias("digest"), "text"), F.xxhash64("digest"), once=2)
    several = sighted.repartition(shards, "digest").sortWithinPartitions("digest", "text").mapInArrow(_bucket, "digest binary").distinct()
    several = materialise(several, "dedup-several")
    if several.isEmpty():  # but for two texts of one digest
        discard(several)
        return groups, None
    apart = texts.withColumn("digest", digest).join(several, "digest", "left_semi").groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return materialise(groups.join(several, "digest", "left_anti").select(groups.columns), "dedup-groups"), materialise(apart, "dedup-apart")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    texts = id_text(docs, id_col, text_col)
    marked = materialise(texts.select("doc_id", digest_of(F.col("text")).alias("digest")), "dedup-rows")
    total = marked.count()
    groups, apart = duplicate_groups(marked, texts, total)
    if apart is None:
        rows = lookup(marked, groups.drop("hashed"), "digest", "group_size", total)
    else:
        told = texts.withColumn("digest", digest_of(F.col("text")))
        several = apart.select("digest").distinct()
        rows = lookup(told.join(several, "digest", "left_anti").select("doc_id", "digest"), groups.drop("hashed"), "digest", "group_size", total)
        rows = rows.unionByName(told.join(several, "digest", "left_semi").join(apart, ["digest", "text"]).select(*rows.columns))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, all columns, without those whose text a row with a larger id has.

    Only texts of a digest that may occur twice are shuffled.
    """
    texts = id_text(docs, id_col, text_col)
    marked = materialise(texts.select("doc_id", digest_of(F.col("text")).alias("digest")), "dedup-rows")
    total = marked.count()
    groups, apart = duplicate_groups(marked, texts, total)
    discard(marked)
    text, row_id = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    digest, keep, size = (fresh(docs, f"dedup_{k}") for k in ("digest", "keep", "size"))
    hashes = groups.select("hashed") if apart is None else groups.select("hashed").unionByName(apart.select(F.xxhash64("digest").alias("hashed")))
    some, others = KeyFilter(hashes, "hashed").split(docs, F.xxhash64(digest_of(text)))
    some = some.withColumn(digest, digest_of(text))
    named = groups.select(F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.col("group_size").alias(size))
    stays = F.col(size).isNull() | row_id.eqNullSafe(F.col(keep))
    if apart is None:
        return others.unionByName(lookup(some, named, digest, size, total).filter(stays).select(*docs.columns))
    several = apart.select(F.col("digest").alias(digest)).distinct()
    kept = lookup(some.join(several, digest, "left_anti"), named, digest, size, total).filter(stays).select(*docs.columns)
    own = apart.select(F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.col("group_size").alias(size), F.col("text").alias(f"{digest}_text"))
    taken = some.join(own, (some[digest] == own[digest]) & (text == F.col(f"{digest}_text"))).filter(stays).select(*(some[c] for c in docs.columns))
    return others.unionByName(kept).unionByName(taken)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
