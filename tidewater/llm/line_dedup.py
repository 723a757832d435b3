r"""Line deduplication over sharded minimal perfect hashes.

A line's key is the line stripped of ASCII whitespace and with A-Z lower-cased; a
key long enough that enough documents hold loses its lines in all of them but
the one of the largest id.

1. Keys become 128-bit hashes.  Each task counts the documents of its hashes, one
   aggregation sums them, and only hashes that reach the threshold go on.
2. These are dealt to shards by hash.  A shard's minimal perfect hash (levels of
   bits; a key's slot is the rank of its bit) indexes dense arrays: a 64-bit
   fingerprint, the count, and the id that keeps the line.
3. Documents probe the arrays; lines are joined with nothing.  Hashes above 1/1000
   of all sightings are at most 1000 by arithmetic: their shard is broadcast and
   probed where the document is.  For the others a document sends the hashes that
   a Bloom filter lets pass to their shard, whose task holds its arrays and answers
   from slot and fingerprint: a probe is 32 bytes, whatever the line.
4. The hashes to drop, collected by document (no more than it has lines), meet the
   documents that have any; the texts of all others stay where they are.

Two lines are taken for equal if 128 bits of their hashes agree, and a line in no
array for one that is if a 64-bit fingerprint agrees too.

Defined results: null or empty text is one empty line; every row counts as a
document, so rows that repeat an id count each, and all rows with the keeping id
keep their lines; ids lose to none, and null ids to every other; where all rows
that hold a key lack an id, all keep it; an empty table gives an empty result;
extra columns are not read; whole texts are read, a slice of SLICE_BYTES (or one
text) at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import HOT_SHARE, KeyFilter, discard, id_text, materialise, slices, table

STRIPPED = " \t\n\v\f\r"
SLICE_BYTES = 4 << 20
SHARD_KEYS = 50_000
SHARD_PROBES = 1_000_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def hashed_lines(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lines by text, and of the lines whose key is long enough: number over all texts, h1, h2)."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    counts = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = pc.ascii_lower(pc.ascii_trim(lines.flatten(), characters=STRIPPED))
    long = np.flatnonzero(pc.utf8_length(keys).to_numpy(zero_copy_only=False) >= min_chars)
    told = keys.take(pa.array(long)).cast(pa.binary()).to_pylist()
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, told)), ">u8").astype(np.uint64).reshape(-1, 2)
    return counts, long, h[:, 0].copy(), h[:, 1].copy()


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, which rows in that order begin a new combination), by all columns, the first one first."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, new


def _by_document(counts: np.ndarray, long: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, h1, h2) once for each key that a document holds."""
    doc = np.repeat(np.arange(len(counts)), counts)[long]
    order, new = _distinct(h1, h2, doc)
    order = order[new]
    return doc[order], h1[order], h2[order]


def _count(min_chars: int):
    """(doc_id, text) to (h1, h2, n, keeper), combined by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1), SLICE_BYTES):
                doc, h1, h2 = _by_document(*hashed_lines(texts, min_chars))
                t = pa.table({"h1": h1.view(np.int64), "h2": h2.view(np.int64), "id": batch.column(0).slice(at, len(texts)).take(pa.array(doc))})
                t = t.group_by(["h1", "h2"], use_threads=False).aggregate([("id", "count", pc.CountOptions(mode="all")), ("id", "max")])
                yield from t.select(["h1", "h2", "id_count", "id_max"]).rename_columns(["h1", "h2", "n", "keeper"]).to_batches()

    return run


class MinimalPerfectHash:
    """Slots 0 .. n-1 for n distinct keys (pairs of 64-bit words), about 3 bits a key.

    At each level a key takes the bit that its hash names, if no other key of that
    level does; the rest go on to the next level.  The slot is the rank of the bit
    over all levels.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes  # bits: 64-bit words, each level from a new word on
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @staticmethod
    def place(level: int, size: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        h = _mix(_mix(h1 + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)) + h2)
        return (((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> MinimalPerfectHash:
        words, sizes = [], []
        while len(h1):
            size = -(-len(h1) // 64) * 64
            at = cls.place(len(sizes), size, h1, h2)
            once = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(once, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = ~once[at]
            h1, h2 = h1[left], h2[left]
        return cls(np.concatenate(words or [np.zeros(0, np.uint64)]), np.array(sizes, np.int64))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Each key's slot; of a key that isn't one of the n, any slot or -1."""
        out, open_, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = self.place(level, size, h1[open_], h2[open_])
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            set_ = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[set_]] = (self.before[word] + below)[set_]
            open_ = open_[~set_]
            base += size // 64
        return out


class Shard:
    """The arrays of one shard: fingerprint, count and keeping id by slot."""

    def __init__(self, mph: MinimalPerfectHash, prints: np.ndarray, counts: np.ndarray, keepers: np.ndarray, named: np.ndarray):
        self.mph, self.prints, self.counts, self.keepers, self.named = mph, prints, counts, keepers, named

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: pa.Array) -> Shard:
        mph = MinimalPerfectHash.build(h1, h2)
        order = np.argsort(mph.slots(h1, h2))
        named = pc.is_valid(keepers).to_numpy(zero_copy_only=False)
        return cls(mph, h2[order], counts[order], pc.fill_null(keepers, 0).to_numpy(zero_copy_only=False)[order], named[order])

    def lost(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, id_named: np.ndarray) -> np.ndarray:
        """Which keys are in the arrays with another keeping id than the document's."""
        if not len(self.prints):
            return np.zeros(len(h1), bool)
        slot = self.mph.slots(h1, h2)
        found = (slot >= 0) & (self.prints[slot] == h2)
        same = np.where(self.named[slot] & id_named, self.keepers[slot] == ids, self.named[slot] == id_named)
        return found & ~same

    FIELDS = "shard int, bits binary, sizes binary, prints binary, counts binary, keepers binary, named binary"

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in (self.mph.bits, self.mph.sizes, self.prints, self.counts, self.keepers, self.named)]

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> Shard:
        kinds = (np.uint64, np.int64, np.uint64, np.int64, np.int64, bool)
        bits, sizes, *arrays = (np.frombuffer(x, k) for x, k in zip(parts, kinds, strict=True))
        return cls(MinimalPerfectHash(bits, sizes), *arrays)


def _shard_of(rows: pa.Table) -> Shard:
    h1, h2, n = (rows.column(c).to_numpy() for c in ("h1", "h2", "n"))
    return Shard.build(h1.view(np.uint64), h2.view(np.uint64), n, rows.column("keeper").combine_chunks())


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    names = [f.split()[0] for f in Shard.FIELDS.split(", ")]
    return pa.table([pa.array([key[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in _shard_of(rows).packed())], names)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False), pc.is_valid(column).to_numpy(zero_copy_only=False)


def _probes(min_chars: int, may, hot):
    """(doc_id, th, text) to (doc_id, th, h1, h2) for the keys that may be in a shard and aren't in the broadcast one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shard.unpacked(hot.value)
        for batch in batches:
            for at, texts in slices(batch.column(2), SLICE_BYTES):
                doc, h1, h2 = _by_document(*hashed_lines(texts, min_chars))
                asked = may(h1 ^ h2)
                if len(own.prints):
                    slot = own.mph.slots(h1, h2)
                    asked &= (slot < 0) | (own.prints[slot] != h2)
                doc, h1, h2 = pa.array(doc[asked]), h1[asked], h2[asked]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(texts)).take(doc) for c in batch.columns[:2]), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["doc_id", "th", "h1", "h2"])

    return run


def _answer(key: tuple, probes: pa.Table, arrays: pa.Table) -> pa.Table:
    """The probes of one shard whose line is lost in their document."""
    if not arrays.num_rows:
        return probes.slice(0, 0).select(["doc_id", "th", "h1"])
    shard = Shard.unpacked([c[0].as_py() for c in arrays.columns[1:]])
    h1, h2 = (probes.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    lost = shard.lost(h1, h2, *_ids(probes.column("doc_id").combine_chunks()))
    return probes.filter(pa.array(lost)).select(["doc_id", "th", "h1"])


def _cut(min_chars: int, hot):
    """(doc_id, text, lost) to (doc_id, text, n_lines, n_dropped)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shard.unpacked(hot.value)
        for batch in batches:
            for at, texts in slices(batch.column(1), SLICE_BYTES):
                ids = batch.column(0).slice(at, len(texts))
                told = batch.column(2).slice(at, len(texts))
                counts, long, h1, h2 = hashed_lines(texts, min_chars)
                doc = np.repeat(np.arange(len(counts)), counts)[long]
                number, named = _ids(ids)
                gone = own.lost(h1, h2, number[doc], named[doc])
                for k in np.flatnonzero(pc.is_valid(told).to_numpy(zero_copy_only=False)).tolist():
                    a, b = np.searchsorted(doc, [k, k + 1])
                    gone[a:b] |= np.isin(h1[a:b].view(np.int64), told[k].values.to_numpy())
                first = np.cumsum(counts) - counts
                dropped = np.bincount(doc[gone], minlength=len(counts))
                touched = np.flatnonzero(dropped)
                kept = []
                for k in touched.tolist():
                    a, b = np.searchsorted(doc, [k, k + 1])
                    out = set((long[a:b][gone[a:b]] - first[k]).tolist())
                    kept.append("\n".join(x for i, x in enumerate(texts[k].as_py().split("\n")) if i not in out))
                if kept:
                    texts = pc.replace_with_mask(texts, pa.array(dropped > 0), pa.array(kept, texts.type))
                yield pa.RecordBatch.from_arrays([ids, texts, pa.array(counts), pa.array(dropped.astype(np.int64))], ["doc_id", "text", "n_lines", "n_dropped"])

    return run


def frequent_lines(texts: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """h1, h2, n, keeper: hashes of keys of at least min_chars that at least min_docs rows of (doc_id, text) hold."""
    sums = texts.select("doc_id", "text").mapInArrow(_count(min_chars), "h1 long, h2 long, n long, keeper long").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
    return sums.filter(F.col("n") >= min_docs)


def drop_repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (without the lines dropped), n_lines (before), n_dropped; one row per input row."""
    spark = docs.sparkSession
    texts = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), "text")
    keys = materialise(frequent_lines(texts, min_docs, min_chars), "line-keys")
    n_keys, sightings = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = sightings // HOT_SHARE + 1
    hot = spark.sparkContext.broadcast(_shard_of(keys.filter(F.col("n") >= least).toArrow()).packed())  # at most 1000 keys
    others = keys.filter(F.col("n") < least)
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_keys // SHARD_KEYS, sightings // SHARD_PROBES)
    shard = F.pmod("h1", F.lit(shards)).cast("int").alias("shard")
    index = materialise(others.select(shard, "h1", "h2", "n", "keeper").groupBy("shard").applyInArrow(_build, Shard.FIELDS), "line-index")
    filter_ = KeyFilter(others.select(F.col("h1").bitwiseXOR(F.col("h2")).alias("h")), "h")
    probes = texts.mapInArrow(_probes(min_chars, filter_.test(), hot), "doc_id long, th long, h1 long, h2 long").select(shard, "doc_id", "th", "h1", "h2")
    lost = probes.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_answer, "doc_id long, th long, h1 long")
    lost = materialise(lost.groupBy("doc_id", "th").agg(F.collect_set("h1").alias("lost")), "line-lost")
    discard(keys, index)
    concerned, rest = KeyFilter(lost.select(F.xxhash64("doc_id", "th").alias("h")), "h").split(texts, F.xxhash64("doc_id", "th"))
    told = concerned.alias("t").join(lost.alias("l"), F.expr("t.th = l.th AND t.doc_id <=> l.doc_id"), "left").select("t.doc_id", "t.text", "l.lost")
    rows = told.unionByName(rest.select("doc_id", "text", F.lit(None).cast("array<long>").alias("lost")))
    return rows.mapInArrow(_cut(min_chars, hot), "doc_id long, text string, n_lines long, n_dropped long")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT row, doc_id, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
k AS (SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT row, doc_id, key FROM l) WHERE length(key) >= 20 GROUP BY 1 HAVING count(*) >= 3),
j AS (SELECT l.*, k.key IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM l LEFT JOIN k USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY row
"""
