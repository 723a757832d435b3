r"""Target-distribution importance resampling over hashed word runs.

Features are the runs of 1 to n words of a text, hashed into buckets.  A bucket's
gain is the logarithm of its smoothed share among a target's features over that
among the corpus's; a document's weight sums the gains of its features, and a
Gumbel draw by seed and id turns weights into a sample without replacement.

1. Texts of more than CHUNK characters are cut at word boundaries into chunks;
   each carries the n - 1 words behind it, so that runs across its end are whole,
   and owns the runs that start in it.  Chunks of long texts are dealt out over
   the cluster, so a long text is the work of many tasks; short ones stay where
   they are.
2. Each task sums counts by bucket over what it reads, and one aggregation sums
   the tasks: `buckets` rows, whatever the corpus, from which the gains are
   broadcast (8 bytes a bucket).
3. A second pass sums gains by chunk; counts and weights of chunks are summed by
   document.  Only these small rows are shuffled.
4. Documents are range-partitioned by score, numbered within their partition, and
   partitions are offset by the counts before them; the counts of partitions are
   all that the driver sees.

Gains are integers (floors go down), so sums don't depend on their order.

Defined results: a null or empty text has no words, no features and weight 0; a
row without an id draws from the empty id and loses ties; rows that repeat an id
are each a document, and draw alike; an empty table or an empty target gives
defined gains by the smoothing (an empty table no rows); extra columns are not
read; whole texts count, however long; runs don't cross documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import discard, id_text, materialise, slices, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
CHUNK = 100_000
SLICE_BYTES = 2 << 20
REMEMBERED = 500_000


def words_of(text: str) -> list[str]:
    """Words with A-Z lower-cased; other letters as they are."""
    return WORD.findall(text.lower() if text.isascii() else text.translate(LOWER))


def chunk_places(text: str, n: int, size: int = CHUNK) -> Iterator[tuple[int, int, int]]:
    """(start, owned end, end with the carry) of chunks of about `size` characters; each boundary is the start of a word, so none is cut.

    The words in [start, owned end) are the starting positions the chunk owns; up
    to n - 1 further words follow in [owned end, end).
    """
    low = text.translate(LOWER) if not text.isascii() else text.lower()
    at = 0
    while at < len(low):
        owned = len(low)
        if at + size < len(low):
            # a word that began before the boundary belongs to this chunk whole
            tail = WORD.match(low, at + size) if WORD.match(low, at + size - 1) else None
            after = WORD.search(low, tail.end() if tail else at + size)
            owned = after.start() if after else len(low)
        end = owned
        for _ in range(n - 1):
            more = WORD.search(low, end)
            if not more:
                break
            end = more.end()
        yield at, owned, end
        at = owned


def _chunks(n: int, size: int):
    """(doc_id, th, text) to (doc_id, th, chunk, owned, text): owned is the length of the part whose words start runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(2)[k].as_py()
                for number, (start, owned, end) in enumerate(chunk_places(text, n, size)):
                    yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns[:2]), pa.array([number], pa.int64()), pa.array([owned - start], pa.int64()), pa.array([text[start:end]])], CHUNK_NAMES)

    return run


CHUNKS = "doc_id long, th long, chunk long, owned long, text string"
CHUNK_NAMES = ["doc_id", "th", "chunk", "owned", "text"]


def chunked(docs: DataFrame, n: int, size: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(short texts as one chunk each, chunks of the texts longer than size), as CHUNKS."""
    rows = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), "text")
    whole = F.length("text")
    short = rows.filter(whole <= size).select("doc_id", "th", F.lit(0).cast("long").alias("chunk"), whole.cast("long").alias("owned"), "text")
    long = rows.filter(whole > size).mapInArrow(_chunks(n, size), CHUNKS)
    return short, long.repartition("doc_id", "th", "chunk")


class Bucketer:
    """Buckets of features, remembered for words up to a number."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def of_words(self, words: list[str]) -> np.ndarray:
        known = self.known
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % self.buckets
        out = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        if len(known) > REMEMBERED:
            known.clear()
        return out

    def features(self, text: str, owned: int, n: int) -> tuple[int, np.ndarray]:
        """(words that start in text[:owned], buckets of the runs of 1 to n words that start there)."""
        words = words_of(text)
        own = len(words) if owned >= len(text) else len(words_of(text[:owned]))
        parts = [self.of_words(words[:own])]
        for k in range(2, n + 1):
            starts = range(max(0, min(own, len(words) - k + 1)))
            parts.append(np.fromiter((zlib.crc32(" ".join(words[i : i + k]).encode("utf-8", "surrogatepass")) % self.buckets for i in starts), np.int64, len(starts)))
        return own, np.concatenate(parts)


def _each(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[np.ndarray]]]:
    bucketer = Bucketer(buckets)
    for batch in batches:
        for at, texts in slices(batch.column(4), SLICE_BYTES):
            part = batch.slice(at, len(texts))
            told = [bucketer.features(t, owned, n) for t, owned in zip(texts.to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield part, [t[0] for t in told], [t[1] for t in told]


def _count(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, _, found in _each(batches, n, buckets):
            total += np.bincount(np.concatenate(found), minlength=buckets) if found else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return run


def _weigh(n: int, buckets: int, gains):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.frombuffer(gains.value, np.int64)
        for part, words, found in _each(batches, n, buckets):
            weights = [int(gain[f].sum()) for f in found]
            columns = [*part.columns[:3], pa.array(words, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array(weights, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "chunk", "n_words", "n_features", "weight"])

    return run


def feature_counts(chunks: tuple[DataFrame, DataFrame], n: int, buckets: int) -> np.ndarray:
    """Features by bucket over all chunks; tasks sum theirs first, so `buckets` rows at most leave each of them."""
    counts = [c.mapInArrow(_count(n, buckets), "bucket long, n long") for c in chunks]
    rows = counts[0].unionByName(counts[1]).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # `buckets` rows at most
    out = np.zeros(buckets, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed share in the target over that in the source), by bucket."""
    s, t, b = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weights(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, size: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of docs."""
    spark = docs.sparkSession
    corpus = chunked(docs, n, size, id_col, text_col)
    aim = chunked(target.select(F.lit(0).alias("target_id"), F.col(target_text).alias("target_text")), n, size, "target_id", "target_text")
    gains = spark.sparkContext.broadcast(gains_of(feature_counts(corpus, n, buckets), feature_counts(aim, n, buckets)).tobytes())
    kind = "doc_id long, th long, chunk long, n_words long, n_features long, weight long"
    short, long = (c.mapInArrow(_weigh(n, buckets, gains), kind) for c in corpus)
    sums = ("n_words", "n_features", "weight")
    # rows that repeat both id and text have the same chunks: as many rows as first chunks, each with its share of the sums
    whole = long.groupBy("doc_id", "th").agg(F.count_if(F.col("chunk") == 0).alias("rows"), *(F.sum(c).alias(c) for c in sums))
    whole = whole.select("doc_id", *(F.expr(f"{c} div rows").alias(c) for c in sums), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row"))
    return short.select("doc_id", *sums).unionByName(whole.select("doc_id", *sums))


def gumbel(seed: int, doc_id: Column) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """rows (a table), numbered from 1 in this order over all of them, as a table.

    The range partitions are written with their numbers, since a partition that
    is made again may be cut elsewhere.
    """
    kept = materialise(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    parts = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))  # a row for each partition
    before = F.sum("__rows").over(Window.orderBy("__part")) - F.col("__rows")
    offsets = F.broadcast(parts.select("__part", before.alias("__before")))
    number = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return kept.withColumn("__number", number).join(offsets, "__part").withColumn(rank, F.col("__number") + F.col("__before")).select(*rows.columns, rank)


def importance_sample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, min_words: int = 20, n: int = 1, buckets: int = 10_000, size: int = CHUNK, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank is null where a document isn't drawn.

    Of the documents with at least min_words words, percent in 100 are drawn, by score.
    """
    weighed = weights(docs, target, n, buckets, size, id_col, text_col, target_text)
    scored = materialise(weighed.withColumn("score", (F.col("weight") + gumbel(seed, F.col("doc_id"))).cast("long")), "importance")
    fit = F.col("n_words") >= min_words
    most = scored.filter(fit).count() * percent // 100
    inside = ranked(scored.filter(fit), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    inside = inside.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank").cast("long")))
    return inside.unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("long")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def oracle_sql(percent: int = 10, seed: int = 2024, min_words: int = 20, buckets: int = 10_000) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def words(name: str) -> str:
        return rf"regexp_extract_all(translate(coalesce({name}, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    return f"""
WITH crc AS (SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) AS v(k)),
d AS (SELECT doc_id, {words("text")} AS ws FROM documents),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d), bw AS (SELECT unnest({words("text")}) AS w FROM benchmark),
v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
h AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {buckets} AS b FROM v, crc),
s AS (SELECT b, count(*) AS n FROM dw JOIN h USING (w) GROUP BY 1), t AS (SELECT b, count(*) AS n FROM bw JOIN h USING (w) GROUP BY 1),
z AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
g AS (SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (z.s + {buckets}) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * (z.t + {buckets}))))::BIGINT AS gain FROM s FULL JOIN t USING (b), z),
w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM dw JOIN h USING (w) JOIN g USING (b) GROUP BY 1),
x AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{seed}:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_features >= {min_words} QUALIFY rank <= (SELECT count(*) FROM x WHERE n_features >= {min_words}) * {percent} // 100)
SELECT doc_id, n_features, weight, score, rank FROM x LEFT JOIN r USING (doc_id)
"""


ORACLE_SQL = oracle_sql()
