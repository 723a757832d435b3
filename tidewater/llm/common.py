"""Helpers shared by the operators of this subpackage.

Conventions: an operator takes a DataFrame with an id column and a text
column (names are parameters), reads only those, and returns a DataFrame with
the columns its docstring lists, so extra input columns never clash.  A null
text counts as the empty text.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL_ROOTS: dict[str, str] = {}  # by application, for local sessions that name no folder


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names; where it names none, one of its own in local mode, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL_ROOTS.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="checkpoints-")
        _LOCAL_ROOTS[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialise() wrote; only for tables nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of an Arrow batch in short slices, to bound what Python holds."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part.column(0), [x or "" for x in part.column(1).to_pylist()]


def slices(column: pa.Array, most: int = 6 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of a string column, each about `most` bytes or one row."""
    sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield at, column.slice(at, end - at)
        at = end


def list_column(values, lengths, kind=pa.int32()) -> pa.ListArray:
    """A list column from flat values (numpy, or bytes of that kind) and lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    flat = pa.array(values, kind) if not isinstance(values, (bytes, bytearray)) else pa.Array.from_buffers(kind, len(values) // (kind.bit_width // 8), [None, pa.py_buffer(values)])
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


HOT_SHARE = 1000


def lookup(rows: DataFrame, groups: DataFrame, keys: str | list[str], weight: str, total: int, how: str = "left") -> DataFrame:
    """rows joined (left or inner) with groups (unique by keys), whose `weight` says how many rows have the keys.

    Rows of hot groups, those of more than 1/1000 of `total` = all rows, meet
    them through a broadcast of at most 1000 groups and never enter a shuffle;
    the other rows go to a shuffled join that has no hot key.  rows is read
    twice, so it should be a table or cheap to compute.
    """
    keys = [keys] if isinstance(keys, str) else keys
    least = total // HOT_SHARE + 1
    names = [*rows.columns, *(c for c in groups.columns if c not in keys)]
    hot = groups.filter(F.col(weight) >= least)
    by_broadcast = rows.join(F.broadcast(hot), keys, "inner").select(*names)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    by_shuffle = others.join(groups.filter(F.col(weight) < least), keys, how).select(*names)
    return by_broadcast.unionByName(by_shuffle)


HELD = 24 << 20
LEAST_BITS, MOST_BITS = 1 << 17, 1 << 27


class KeyFilter:
    """A Bloom filter over 64-bit hashes, to spare most rows a shuffle.

    Its size follows the number of rows given (12 to 24 bits for each), from 16 KB
    to 16 MB; above 11 million rows it stays there and lets more of the others
    pass, which costs their shuffle and nothing else.  Built by an aggregation of
    (word, bits), so tasks combine theirs before one row a 64-bit word, 2^21 at
    most, reaches the driver.
    """

    def __init__(self, hashes: DataFrame, column: str):
        spark, h = hashes.sparkSession, F.col(column)
        hashes = hashes.filter(h.isNotNull())
        self.bits = LEAST_BITS
        wanted = 12 * hashes.count()
        while self.bits < min(wanted, MOST_BITS):
            self.bits *= 2
        last = F.lit(self.bits - 1).cast("long")
        places = F.array(h.bitwiseAND(last), F.shiftrightunsigned(h, 37).bitwiseAND(last))
        at = hashes.select(F.explode(places).alias("at"))
        bit = F.expr("shiftleft(1L, int(at & 63L))")
        words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        packed = np.zeros(self.bits // 64, np.int64)
        packed[words.column(0).to_numpy()] = words.column(1).to_numpy()
        self.shared = spark.sparkContext.broadcast(packed.tobytes())

    def test(self):
        """A function for tasks: which hashes of an array may be in the filter."""
        shared, last = self.shared, np.uint64(self.bits - 1)

        def may(h: np.ndarray) -> np.ndarray:
            bits, h = np.frombuffer(shared.value, np.uint8), h.view(np.uint64)
            a, b = (h & last).astype(np.int64), ((h >> np.uint64(37)) & last).astype(np.int64)
            return ((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1) == 1

        return may

    def split(self, source: DataFrame, hashed: Column, once: int = 0) -> tuple[DataFrame, DataFrame]:
        """(rows whose hash may be in the filter, rows whose hash is not), each a pass over source.

        once: of the former, a task tells one of the rows that repeat so many first columns (0: all), as far as it remembers (HELD bytes of text).
        """
        may, kind, name = self.test(), source.schema, fresh(source, "hashed")

        def keep(inside: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                seen, size = set(), 0
                for batch in batches:
                    held = may(batch.column(batch.num_columns - 1).to_numpy())
                    part = batch.filter(pa.array(held if inside else ~held))
                    if inside and once:
                        new = np.zeros(part.num_rows, bool)
                        for k, key in enumerate(zip(*(c.to_pylist() for c in part.columns[:once]), strict=True)):
                            new[k] = key not in seen
                            if new[k]:
                                seen.add(key)
                                size += 100 + sum(len(x) for x in key if isinstance(x, (str, bytes)))
                        part = part.filter(pa.array(new))
                        if size > HELD:
                            seen, size = set(), 0
                    yield pa.RecordBatch.from_arrays(part.columns[:-1], kind.names)

            return run

        marked = source.select("*", hashed.alias(name))
        return marked.mapInArrow(keep(True), kind), marked.mapInArrow(keep(False), kind)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    while name in df.columns:
        name += "_"
    return name
