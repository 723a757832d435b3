"""Best-fit packing of documents into sequences by bin completion.

1. One pass encodes the texts and cuts only longer ones into pieces of the
   capacity.  Each task numbers its pieces of equal length as they come, so
   pieces go to the shared folder without a shuffle, with their part and rank.
2. Packing needs the histogram of lengths alone: at most `capacity` rows reach
   the driver, and bin_completion gives fillings with their numbers of sequences.
3. Counts of (part, length), summed over parts in a window, say where the ranks
   of a part begin.  They join the pieces by (part, length), whose groups are no
   larger than a task's input, so a length that a third of all rows share is
   dealt out like any other; the counts are broadcast up to FEW_COUNTS rows.
4. Pieces of one length fill the places for that length in order of rank, so
   every piece finds its sequence and offset from its own row and the plan.
   Workers let go of their encoders there.

Defined results: null or empty text is its end id alone (without one, no piece);
rows that repeat an id, or have none, are packed each; an empty table gives an
empty result; extra columns are not read; a very long text is encoded whole and
becomes many pieces.  `gap` is by how many sequences the packing may exceed the
fewest possible: 0 where it is proven to be minimal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.bin_completion import Plan, pack
from tidewater.llm.common import discard, id_text, materialise, table
from tidewater.llm.encoding import SLICE_BYTES, encoder, forget_encoders, release_unused, slices
from tidewater.llm.token_files import with_end

CAPACITY = 2048
FEW_COUNTS = 500_000  # of 24 bytes
PLACED = 1024  # pieces placed and returned at once, of 8 KB at most
PIECES = "doc_id long, piece int, start long, length long, ids binary"
NAMES = ["doc_id", "piece", "start", "length", "ids"]


def _cut(tokenizer: str, end_id: int | None, capacity: int, slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        kind = np.dtype("<u2" if len(own.token_bytes) <= 1 << 16 else "<u4")
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at, texts in slices(batch.column(1), slice_bytes):
                ids, counts = with_end(*own.encode(texts), end_id)
                pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, counts[doc] - start)
                edges = np.concatenate([[0], np.cumsum(length)]) * kind.itemsize
                raw = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(counts)).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), raw, pa.array(np.full(len(doc), part, np.int32)), pa.array(_ranks(length, seen))], [*NAMES, "part", "rank"])
        release_unused()

    return run


def _ranks(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The place of each among the equal ones so far; seen: how many of each were before, brought up to date."""
    order = np.argsort(lengths, kind="stable")
    found, first, counts = np.unique(lengths[order], return_index=True, return_counts=True)
    out = np.zeros(len(lengths), np.int64)
    out[order] = np.arange(len(lengths)) - np.repeat(first, counts) + np.repeat(seen[found], counts)
    seen[found] += counts
    return out


def places(plan: Plan) -> dict[str, np.ndarray]:
    """For each length and filling: ranks from `first` on go to sequences from `sequence` on."""
    rows, sequence, ranks = [], 0, {}
    for filling, bins in plan:
        offset = 0
        for size, copies in filling:
            rows.append((size, ranks.get(size, 0), copies, sequence, offset))
            ranks[size] = ranks.get(size, 0) + copies * bins
            offset += size * copies
        sequence += bins
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "copies", "sequence", "offset"), columns, strict=True))


def _widen(ids: pa.Array, lengths: np.ndarray) -> pa.Array:
    """The ids with 32 bits each."""
    ids = ids.cast(pa.binary())
    edges = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    if edges[-1] - edges[0] != 2 * lengths.sum():
        return ids
    wide = np.frombuffer(ids.buffers()[2], np.uint8)[edges[0] : edges[-1]].view("<u2").astype("<u4")
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(2 * (edges - edges[0])), pa.py_buffer(wide)])


def _place(slots: dict[str, np.ndarray], gap: int, wide: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        keys = slots["length"] * (1 << 48) + slots["first"]  # sorted; ranks stay below 2^48
        for batch in (whole.slice(at, PLACED) for whole in batches for at in range(0, whole.num_rows, PLACED)):
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            slot = np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1
            nth = rank - slots["first"][slot]
            sequence = slots["sequence"][slot] + nth // slots["copies"][slot]
            offset = slots["offset"][slot] + nth % slots["copies"][slot] * length
            ids = _widen(batch.column(4), length) if wide else batch.column(4)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], ids, pa.array(sequence), pa.array(offset), pa.array(np.full(len(rank), gap, np.int64))], [*NAMES, "sequence_id", "offset", "gap"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 0, capacity: int = CAPACITY, slice_bytes: int = SLICE_BYTES, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian, 16 bits where the vocabulary allows, else 32), sequence_id, offset, gap.

    slice_bytes: text encoded at once; less takes less memory and more time.
    wide: ids of 32 bits in any case; they are stored as narrow as before and widened once they are placed.
    """
    cut = id_text(docs, id_col, text_col).mapInArrow(_cut(tokenizer, end_id, capacity, slice_bytes), PIECES + ", part int, rank long")
    pieces = materialise(cut, "pieces")
    counts = materialise(pieces.groupBy("part", "length").agg((F.max("rank") + 1).alias("n")), "piece-counts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part
    bases = materialise(counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base")), "piece-bases")
    lengths = counts.groupBy("length").agg(F.sum("n").alias("n")).toArrow()  # at most `capacity` rows
    packing = pack(dict(zip(lengths.column(0).to_pylist(), lengths.column(1).to_pylist(), strict=True)), capacity)
    discard(counts)
    bases = F.broadcast(bases) if bases.count() <= FEW_COUNTS else bases.hint("merge")
    ranked = pieces.join(bases, ["part", "length"]).select(*NAMES, (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(_place(places(packing.plan), packing.gap, wide), PIECES + ", sequence_id long, offset long, gap long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, pieces (array of offset, doc_id, piece, length, ids in order of place)."""
    one = F.struct("offset", "doc_id", "piece", "length", "ids")
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(one)).alias("pieces"))  # at most `capacity` tokens


def with_crc(packed: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids, as little-endian numbers of 32 bits, in place of the ids.

    An expression and no Python pass, which would run beside that of the places and so need two workers a task.
    Narrow ids are widened through their hexadecimal text, which costs far more than `wide` where they are packed.
    """
    narrow = F.length("ids") == 2 * F.col("length")
    wide = F.unhex(F.regexp_replace(F.hex("ids"), "(?<id>.{4})", "${id}0000"))
    return packed.select(*NAMES[:4], F.crc32(F.when(narrow, wide).otherwise(F.col("ids"))).alias("ids_crc32"), "sequence_id", "offset", "gap")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_crc(pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), wide=True))
