"""Exact n-gram Jaccard join: linked documents and their components.

1. One pass turns each text into its set of word shingles (64-bit hashes); sets
   that are equal are one class from here on, named by 64 bits of their digest
   and checked by 64 more (classes that share a name are renamed), so copies
   never meet each other.  Names and sizes are written, sets aren't: what needs them
   makes them again from the text.
2. Sets are dealt to partitions without loss: sizes fall into classes of ratio
   RATIO; within the class of the larger set, two linked sets differ in at most d
   shingles, so if the hash space is cut into more than d segments, one segment is
   the same in both.  Each set sends the key of each of its segments (to its own
   class, and to the next where its size may link there).  Segments empty in both
   don't count: a set with too few full segments is cut again with another seed,
   so the guarantee rests on full ones.  There are more segments than differences
   by some margin, and linked sets share at least their full segments less d: so a
   set with fewer common keys (HOT sets or more have them) than that does without
   those.  A passage that many texts share so ties none of them, while copies of
   one text, nearly all of whose keys are common, stay together.
   A key that very many sets have is told beforehand by a sample of 1/SAMPLE of the
   texts: its rows are common without being counted, so they are dealt out by set
   and never meet in one task.  Any choice of such keys gives the same links.
3. A key that fewer than HOT sets have ties them in pairs, counted over all keys
   and kept if the count reaches both margins less the sets' common keys; a set
   and its smaller partners are then tied to the smallest of these only, so that
   many like sets don't make as many ties as pairs.  In a common key, the sets whose
   common keys reach their margin are tied to the smallest only (a star, linear in
   the group).  Ties make families, which no link leaves.
4. A family of up to BLOCK sets is one task: a signature tree over it, traversed
   against itself, finds its links.  In a larger one, ties are verified first, in
   salted groups around their centres; where that connects it (copies of one text
   do), it is done.  Where few sets (FEW blocks) stay outside the largest component,
   the family is cut into blocks by size, and signature trees of blocks whose sizes
   may link are traversed against each other, skipping pairs within that component.
   The sets of other families are dealt again by finer segments (FINENESS; the last
   has about one for each shingle), so what only a common passage tied is told
   apart; what the finest leaves is cut into blocks all the same.
5. Components spread back to classes and rows.

Nothing of the size of the corpus reaches the driver.  Memory of a task is one
centre, or two blocks of BLOCK sets.

Defined results: null, empty or blank text has an empty set and is linked with
nothing (its own id is its component); a text shorter than a shingle is one
shingle; rows that repeat an id are documents of their own, by their text; rows
without an id count as documents and get the smallest id of their component,
null if it has none; an empty table gives an empty result; extra columns are
not read.  one_of_each keeps of each component the row of the smallest id
(before rows without one; of several such rows the one of the smallest text
hash; rows that repeat both stay together), and every row without words.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import KeyFilter, discard, fresh, id_text, lookup, materialise, slices, table
from tidewater.llm.components import connected_components
from tidewater.llm.signature_tree import find_links, links

RATIO = 1.5
FINENESS = (1.5, 3.0, 6.0)  # segments for each difference, in rounds
SEEDS = 5
HOT = 32
SAMPLE = 64
MOST_HOT = 100_000  # keys told beforehand; by their threshold there are no more
BLOCK = 512
FEW = 8
CENTRE_MEMBERS = 256
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles, A-Z lower-cased."""
    cut = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.array([len(c) for c in cut])
    digest = xxhash.xxh64_intdigest
    words = np.fromiter((digest(w) for c in cut for w in c), np.uint64, int(counts.sum()))
    h = words.copy()
    for k in range(1, n):
        if len(words) > k:
            h[: len(h) - k] = _mix(h[: len(h) - k]) + words[k:] * _M1
    h = _mix(h)
    out, at = [], 0
    for c in counts.tolist():
        if c >= n:
            s = np.sort(h[at : at + c - n + 1])
            if len(s) > 1:
                s = s[np.append(True, s[1:] != s[:-1])]
        elif c:
            s = np.array([digest(b" ".join(cut[len(out)]), seed=c)], np.uint64)
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
        at += c
    return out


def size_classes(percent: int, most: int = 1 << 40) -> list[tuple[int, int]]:
    """(smallest size, most differing shingles) of each class; in the first one only equal sets link."""
    out, low = [], 1
    high = (100 + percent - 1) // (2 * (100 - percent)) if percent < 100 else most
    while low < most:
        out.append((low, 2 * high * (100 - percent) // (100 + percent)))
        low = high + 1
        high = max(low, int(low * RATIO))
    return out


def segment_keys(s: np.ndarray, percent: int, classes: list[tuple[int, int]], fineness: float = FINENESS[0], keyed: bool = True) -> tuple[np.ndarray, list[int]]:
    """Keys such that two different sets that link have one in common, and how many they must share at least.

    The last bit of a key is that of its class; a set is in two classes at most,
    next to each other, so it has a margin (full segments less differences) for
    each bit.  A margin of 0 says nothing.  keyed: False gives the margins alone.
    """
    n, out, margins = len(s), [], [0, 0]
    own = int(np.searchsorted([low for low, _ in classes], n, "right")) - 1
    for c in range(max(own, 0), len(classes)):
        low, most = classes[c]
        if c > own and 100 * n < percent * low:
            break
        if most == 0 or n == 0:
            continue
        segments = int((most + 1) * fineness) + 4
        for seed in range(SEEDS):
            h = s if not seed else np.sort(_mix(s + np.uint64(seed * int(_M1) & (1 << 64) - 1)))
            at = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
            starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            if keyed:
                tag = at[starts] + np.uint64(c << 40) + np.uint64(seed << 56)
                out.append(_with_bit(_mix(np.add.reduceat(_mix(h), starts) ^ _mix(tag * _M1)), c))
            if len(starts) > most:
                margins[c & 1] = 0 if seed else len(starts) - most
                break
        else:  # as good as impossible: then the empty segments count too
            empty = np.setdiff1d(np.arange(segments, dtype=np.uint64), at[starts])
            out.append(_with_bit(_mix(_mix((empty + np.uint64(c << 40) + np.uint64(255 << 56)) * _M1)), c))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), margins


def _with_bit(keys: np.ndarray, c: int) -> np.ndarray:
    return keys >> np.uint64(1) << np.uint64(1) | np.uint64(c & 1)


def _name(s: np.ndarray, bits: int) -> tuple[int, int]:
    """128 bits of the set's digest, as (name, check), of the name so many bits."""
    d = xxhash.xxh128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True) >> (64 - bits), int.from_bytes(d[8:], "little", signed=True)


def _key_columns(told: list[tuple[np.ndarray, list[int]] | None]) -> list[pa.Array]:
    """Columns of keys and margins, null where a set sends none."""
    lengths = [0 if t is None else len(t[0]) for t in told]
    flat = [t[0] for t in told if t is not None]
    offsets = pa.array([None if t is None else at for t, at in zip([*told, 0], np.concatenate([[0], np.cumsum(lengths)]).tolist(), strict=True)], pa.int32())
    keys = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat or [np.zeros(0, np.uint64)]).view(np.int64)))
    return [keys, pa.array([None if t is None else t[1] for t in told], pa.list_(pa.int32()))]


SLICE_BYTES = 1 << 20
NAME_BITS = 64


def _sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """shingle_sets() of a column, with the words of a slice at a time in memory."""
    for _, part in slices(texts, SLICE_BYTES):
        yield from shingle_sets(part.to_pylist(), n)


def _describe(n: int, percent: int, bits: int):
    """(doc_id, th, text) to what is written of a set, without its keys."""
    classes = size_classes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(2), SLICE_BYTES):
                part = batch.slice(at, len(texts))
                sets = shingle_sets(texts.to_pylist(), n)
                names = [_name(s, bits) for s in sets]
                margins = [segment_keys(s, percent, classes, keyed=False)[1] for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns, pa.array(margins, pa.list_(pa.int32()))], ["doc_id", "th", "n_shingles", "id", "check", "margins"])

    return run


def _first_keys(n: int, percent: int, bits: int):
    """text to id, check, keys of its set; copies within a task send theirs once, empty sets send none."""
    classes = size_classes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, texts in slices(batch.column(0), SLICE_BYTES):
                new = {}
                for s in shingle_sets(texts.to_pylist(), n):
                    name = _name(s, bits)
                    if len(s) and name not in seen:
                        seen.add(name)
                        new[name] = segment_keys(s, percent, classes)
                if len(seen) > 100_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in new], pa.int64()), pa.array([b for _, b in new], pa.int64()), _key_columns(list(new.values()))[0]], ["id", "check", "keys"])

    return run


def _deal_again(n: int, percent: int, fineness: float):
    """(id, text) to id, keys, margins with segments of another fineness."""
    classes = size_classes(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(1), SLICE_BYTES):
                told = [segment_keys(s, percent, classes, fineness) for s in shingle_sets(texts.to_pylist(), n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *_key_columns(told)], ["id", "keys", "margins"])

    return run


def _rename(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """rows (id, check, ...) where the ids in shared are told apart by the check."""
    new = F.when(F.col("twice"), F.xxhash64("id", "check")).otherwise(F.col("id"))
    return rows.join(F.broadcast(shared), "id", "left").withColumn("id", new).select(*rows.columns)


def _apart(described: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The same rows, where classes that share a name but not the check have new names, and how to rename others so."""
    renamed = []
    while True:
        shared = described.groupBy("id").agg(F.min("check").alias("low"), F.max("check").alias("high")).filter("low <> high").select("id", F.lit(True).alias("twice"))
        shared = materialise(shared, "near-shared")
        if shared.isEmpty():  # but for one pair of classes in 2^64, so these tables are tiny
            discard(shared)
            return described, renamed
        renamed.append(shared)
        told = materialise(_rename(described, shared), "near-renamed")
        discard(described)
        described = told


def _meet(most: int):
    """Rows (key, id, salt) sorted by key and id to (key, id, other > id) of keys with 2 to most - 1 sets, (key, id, null) of larger ones.

    A key's rows may come in several batches; of one with `most` rows or more, none is held back.
    A salt of 0 or more says that the key is common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, hot, before = None, np.zeros(0, np.int64), False, (None, None)

        def close() -> list[tuple[np.ndarray, ...]]:
            return [] if hot or len(held) < 2 else pairs(np.full(1, key), held[None, :])

        def pairs(keys: np.ndarray, members: np.ndarray) -> list[tuple[np.ndarray, ...]]:
            x, y = np.triu_indices(members.shape[1], 1)
            return [(np.repeat(keys, len(x)), members[:, x].ravel(), members[:, y].ravel())]

        def batch_of(told: list[tuple[np.ndarray, ...]], lone: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            k = [t[0] for t in told] + [t[0] for t in lone]
            i = [t[1] for t in told] + [t[1] for t in lone]
            n = sum(len(t[0]) for t in lone)
            other = pa.concat_arrays([pa.array(np.concatenate([t[2] for t in told] or [np.zeros(0, np.int64)])), pa.nulls(n, pa.int64())])
            empty = [np.zeros(0, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(k or empty)), pa.array(np.concatenate(i or empty)), other], ["key", "id", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, i, salted = (c.to_numpy() for c in batch.columns)
            new = np.append((k[0], i[0]) != before, (k[1:] != k[:-1]) | (i[1:] != i[:-1]))
            k, i, salted, before = k[new], i[new], salted[new] >= 0, (k[-1], i[-1])  # a class that several tasks met
            told, lone = [], [(k[salted], i[salted])]
            k, i = k[~salted], i[~salted]
            if not len(k):
                yield batch_of([], lone)
                continue
            starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            sizes = np.diff(np.append(starts, len(k)))
            if k[0] == key:  # goes on from the last batch
                rows = i[: sizes[0]]
                if hot:
                    lone.append((np.full(len(rows), key), rows))
                else:
                    held = np.append(held, rows)
                    if len(held) >= most:
                        lone.append((np.full(len(held), key), held))
                        hot, held = True, held[:0]
                starts, sizes = starts[1:], sizes[1:]
            if len(starts):
                told += close()
                last, size = starts[-1], sizes[-1]
                for n in np.unique(sizes[:-1]).tolist():
                    at = starts[:-1][sizes[:-1] == n]
                    if 1 < n < most:
                        told += pairs(k[at], i[at[:, None] + np.arange(n)])
                    elif n >= most:
                        places = (at[:, None] + np.arange(n)).ravel()
                        lone.append((k[places], i[places]))
                key, held, hot = k[last], i[last:].copy(), False
                if size >= most:
                    lone.append((np.full(size, key), held))
                    hot, held = True, held[:0]
            yield batch_of(told, lone)
        yield batch_of(close(), [])

    return run


def _verify(n: int, percent: int):
    """Rows of one centre after another, its own text first, to the links found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, of = None, None
        for batch in batches:
            found = []
            for c, i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _sets(batch.column(2), n), strict=True):
                if i == c:
                    centre, of = c, s
                elif c == centre and links(of, s, percent):
                    found.append((c, i))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return run


def _join_blocks(n: int, percent: int, whole: bool):
    """Rows of one task key after another (two blocks, or one with itself) to links between components.

    whole: a task key has all that may link, so the components are final, and each
    set of one is told with its smallest as (smallest, set), that one included.
    """

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        ids, sets = [r[2] for r in rows], [r[4] for r in rows]
        labels, sides = np.array([r[3] for r in rows]), np.array([r[1] for r in rows])
        found = [(ids[x], ids[y]) for x, y in find_links(sets, labels, percent, None if sides.max() == 0 else sides)]
        if not whole:
            return found
        root = {i: i for pair in found for i in pair}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in found:
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        return [(find(i), i) for i in root]

    def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []
        for batch in batches:
            found = []
            for r in zip(*(c.to_pylist() for c in batch.columns[:4]), _sets(batch.column(4), n), strict=True):
                if r[0] != task and rows:
                    found += solve(rows)
                    rows = []
                task = r[0]
                rows.append(r)
            yield batch_of(found)
        if rows:
            yield batch_of(solve(rows))

    return run


PAIR = "a long, b long"


def _starred(pairs: DataFrame) -> DataFrame:
    """Edges (a, b) that join what the pairs (a < b) join: each set and its other smaller partners are tied to the smallest of these.

    Of sets that are all paired with each other, one edge a set remains and not
    one for every two.  A window holds the smaller partners of one set, less than
    HOT for each of its keys.
    """
    told = pairs.select("a", "b", F.min("a").over(Window.partitionBy("b")).alias("least"))
    return told.select(F.col("least").alias("a"), F.when(F.col("a") == F.col("least"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()


def _likely(met: DataFrame, margins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges a < b that join the pairs that may link, by their common keys; common keys (key, id) of the sets that only these tell)."""
    bit = F.col("key").bitwiseAND(F.lit(1)).cast("int").alias("bit")
    pairs = met.filter("other IS NOT NULL").groupBy(F.col("id").alias("a"), F.col("other").alias("b"), bit).agg(F.count(F.lit(1)).alias("shared"))
    common = met.filter("other IS NULL").select("key", "id", bit)
    # for each set and bit, how many keys that aren't common a link must share
    counts = common.groupBy("id", "bit").agg(F.count(F.lit(1)).alias("common"))
    need = margins.select("id", F.posexplode("margins").alias("bit", "margin")).join(counts, ["id", "bit"], "left")
    need = need.select("id", "bit", (F.col("margin") - F.coalesce("common", F.lit(0))).alias("need"), (F.coalesce("common", F.lit(0)) > 0).alias("some"))
    need = materialise(need.filter("need > 1 OR some"), "near-need")  # without a row, one shared key may do
    for side in ("a", "b"):
        own = need.select(F.col("id").alias(side), "bit", "need")
        pairs = pairs.join(own, [side, "bit"], "left").filter(F.col("shared") >= F.coalesce("need", F.lit(1))).drop("need")
    rows = materialise(common.join(need.filter("some AND need <= 0").select("id", "bit"), ["id", "bit"]).select("key", "id"), "near-common")
    likely = materialise(_starred(_starred(pairs)), "near-likely")  # once more, for a set of many partners has several smallest ones of theirs
    discard(need)
    return likely, rows


def _hot_keys(sample: DataFrame) -> DataFrame:
    """key: keys of at least HOT sets in a sample of (id, keys) that have at least 1 / MOST_HOT of all its keys, so MOST_HOT at most."""
    keys = sample.select(F.explode("keys").alias("key"), "id").distinct()
    counts = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "near-sampled")
    least = max(HOT, int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // MOST_HOT + 1)
    return counts.filter(F.col("n") >= least).select("key")


def _candidates(told: DataFrame, margins: DataFrame, sample: DataFrame) -> DataFrame:
    """Of sets (id, keys; id, margins): ties (a < b) that make families; their number follows that of the sets and their keys, not that of pairs."""
    shuffles = int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(_hot_keys(sample).withColumn("hot", F.lit(True)))
    exploded = told.select(F.explode("keys").alias("key"), "id").join(hot, "key", "left")
    exploded = exploded.select("key", "id", F.when(F.col("hot"), F.pmod(F.hash("id"), F.lit(4096))).otherwise(F.lit(-1)).cast("int").alias("salt"))
    exploded = exploded.repartition(shuffles, "key", "salt").sortWithinPartitions("key", "id")
    met = materialise(exploded.mapInArrow(_meet(HOT), "key long, id long, other long").filter("id IS NOT NULL"), "near-met")
    likely, rows = _likely(met, margins)
    discard(met)
    # each set beside the smallest set of each of its common keys, and the smallest of all these
    first = materialise(rows.groupBy("key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("n")), "near-first")
    beside = lookup(rows, first, "key", "n", rows.count()).select("id", "centre")
    tied = materialise(beside.withColumn("least", F.min("centre").over(Window.partitionBy("id"))).distinct(), "near-tied")
    # a star of each set and its smallest one, which stands for it in ties to the others; few, as a group's sets mostly share it
    stars = tied.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    ties = materialise(stars.unionByName(tied.filter("least <> centre").select(F.col("least").alias("a"), F.col("centre").alias("b"))).unionByName(likely).distinct(), "near-ties")
    discard(rows, first, tied, likely)
    return ties


def _pair_links(texts: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (id, centre) that are links; pairs is a table."""
    centres = pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("members"))
    salts = materialise(centres.select("centre", "members", (F.col("members") / CENTRE_MEMBERS).cast("int").alias("salts")), "near-salts")
    total = pairs.count()
    dealt = lookup(pairs, salts, "centre", "members", total)
    members = dealt.select("centre", "id", F.pmod(F.hash("id"), F.col("salts") + 1).cast("int").alias("salt"), F.lit(1).alias("role"))
    own = salts.select("centre", F.col("centre").alias("id"), F.explode(F.sequence(F.lit(0), "salts")).alias("salt"), F.lit(0).alias("role"))
    rows = texts.join(members.unionByName(own), "id")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "centre", "salt").sortWithinPartitions("centre", "salt", "role", "id")
    return rows.select("centre", "id", "text").mapInArrow(_verify(n, percent), PAIR)


def _family_links(placed: DataFrame, n: int, percent: int) -> DataFrame:
    """(a: smallest set of the component, b: set) of the linked sets in families of up to BLOCK sets, one signature tree a family.

    placed: id, family, members, text.
    """
    rows = placed.filter(F.col("members") <= BLOCK).select(F.col("family").alias("task"), F.lit(0).alias("side"), "id", F.col("id").alias("component"), "text")
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "task").sortWithinPartitions("task", "id")
    return rows.mapInArrow(_join_blocks(n, percent, True), PAIR)


def _block_links(texts: DataFrame, rest: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between components of large families: rest (family, id, component, main, size).

    Blocks hold sets of one size class; sets link within a class or with the next,
    and pairs within a family's largest component are known.
    """
    step = F.log(F.lit(100.0 / percent)) if percent < 100 else F.lit(1.0)
    rows = rest.select("family", "id", "component", (F.col("component") == F.col("main")).alias("known"), F.floor(F.log(F.col("size").cast("double")) / step + 1e-9).cast("int").alias("range"))
    counts = rows.groupBy("family", "range", "known").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "near-counts")
    rows = lookup(rows, counts, ["family", "range", "known"], "n", rows.count())
    rows = rows.withColumn("block", F.pmod(F.hash("id"), F.col("blocks")).cast("int")).select("family", "range", "known", "block", "id", "component")
    every = counts.select("family", "range", "known", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    near = every.select("family", F.explode(F.array(*(F.col("range") + k for k in (-1, 0, 1)))).alias("range"), F.struct("range", "known", "block").alias("with"))
    near = near.groupBy("family", "range").agg(F.collect_list("with").alias("partners"))  # as many as the family has blocks
    mine = F.struct("range", "known", "block")
    meets = every.join(near, ["family", "range"]).select("family", "range", "known", "block", F.filter("partners", lambda p: ~(F.col("known") & p["known"])).alias("partners"))
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.join(meets, ["family", "range", "known", "block"]).select("family", "id", "component", mine.alias("own"), F.explode("partners").alias("with"))
    task = F.concat_ws(":", F.col("family").cast("string"), F.to_json(F.least("own", "with")), F.to_json(F.greatest("own", "with")))
    dealt = dealt.select(task.alias("task"), (F.col("own") > F.col("with")).cast("int").alias("side"), "id", "component").join(texts, "id")
    dealt = dealt.repartition(parts, "task").sortWithinPartitions("task", "side", "id")
    return dealt.select("task", "side", "id", "component", "text").mapInArrow(_join_blocks(n, percent, False), PAIR)


def _texts_of(source: DataFrame, heads: DataFrame) -> DataFrame:
    """id, size, family, members, text of the classes in heads (id, size, family, members, head); texts are shuffled once."""
    names = ["id", "size", "family", "members"]
    heads = heads.select(*names, F.col("head.doc_id").alias("doc_id"), F.col("head.th").alias("th"))
    likely, _ = KeyFilter(heads.select(F.xxhash64("doc_id", "th").alias("h")), "h").split(source.select("doc_id", "th", "text"), F.xxhash64("doc_id", "th"), once=2)
    found = likely.alias("s").join(heads.alias("h"), F.expr("s.th = h.th AND s.doc_id <=> h.doc_id")).select("s.th", *(f"h.{c}" for c in names), "s.text")
    # a row that several tasks met is dropped where the join has put it
    return found.dropDuplicates(["th", "id"]).select(*names, "text")


def _all(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def _links(source: DataFrame, told: DataFrame, margins: DataFrame, sample: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """id, component of the linked classes; told: id, keys of every class, margins: id, margins, sample: rows like told of a part of the classes."""
    solved, found, texts, labels = [], [], None, None
    for fineness in (*FINENESS[1:], None):
        edges = _candidates(told, margins, sample)
        families = connected_components(edges).withColumnRenamed("component", "family")
        members = families.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
        families = materialise(lookup(families, members, "family", "members", families.count()), "near-families")
        if texts is None:
            heads = materialise(classes.join(families, "id").select("id", "size", "family", "members", "head"), "near-heads")
            every = placed = materialise(_texts_of(source, heads), "near-texts")
            discard(heads)
            # later steps and rounds concern the sets of large families alone
            texts = placed.filter(F.col("members") > BLOCK).select("id", "size", "text")
        else:
            placed = texts.join(families, "id")
        small = materialise(_family_links(placed, n, percent), "near-small")
        # of the first round they are final; later ones may belong to a family that is in pieces
        (found if solved else solved).append(small)
        large = families.filter(F.col("members") > BLOCK)
        if large.isEmpty():
            discard(edges)
            labels = None
            break
        pairs = materialise(edges.select(F.col("b").alias("id"), F.col("a").alias("centre")).join(large.select("id"), "id"), "near-pairs")
        discard(edges)
        found.append(materialise(_pair_links(texts, pairs, n, percent), "near-stars"))
        labels = connected_components(_all(found))
        large = materialise(large.select("id", "family").join(labels, "id", "left").select("id", "family", F.coalesce("component", "id").alias("component")), "near-large")
        sizes = large.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
        heads = sizes.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts"))
        heads = materialise(heads, "near-mains")
        rest = lookup(large, heads, "family", "all", large.count()).filter("parts > 1").withColumn("few", (F.col("all") - F.col("inside") <= FEW * BLOCK) | F.lit(fineness is None))
        rest = materialise(rest.join(texts.select("id", "size"), "id"), "near-rest")
        discard(pairs, large, heads)
        counts = {r["few"]: r["count"] for r in rest.groupBy("few").count().collect()}  # two rows
        if counts.get(True):
            found.append(materialise(_block_links(texts, rest.filter("few"), n, percent), "near-blocks"))
            labels = None
        if not counts.get(False):
            break
        told = materialise(texts.join(rest.filter("NOT few").select("id"), "id").select("id", "text").mapInArrow(_deal_again(n, percent, fineness), "id long, keys array<long>, margins array<int>"), "near-keys")
        margins, sample = told.select("id", "margins"), told.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    if found and labels is None:
        labels = connected_components(_all(found))
    done = solved[0].select(F.col("b").alias("id"), F.col("a").alias("component"))
    discard(every)
    return done if labels is None else done.unionByName(labels)


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, head (doc_id and th of the row that stands for the component, null for an empty set); one row per input row."""
    source = id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("th"), "text")
    described, renamed = _apart(materialise(source.mapInArrow(_describe(n, percent, NAME_BITS), "doc_id long, th long, n_shingles long, id long, check long, margins array<int>"), "near-described"))
    sets = described.select("doc_id", "th", "n_shingles", "id")
    head = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "th")
    classes = described.filter("n_shingles > 0").groupBy("id").agg(F.min(head).alias("head"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("size"), F.first("margins").alias("margins"))
    classes = materialise(classes, "near-classes")

    def keys(rows: DataFrame) -> DataFrame:
        return functools.reduce(_rename, renamed, rows.select("text").mapInArrow(_first_keys(n, percent, NAME_BITS), "id long, check long, keys array<long>")).select("id", "keys")

    sample = source.filter(F.pmod("th", F.lit(SAMPLE)) == 0)
    labels = _links(source, keys(source), classes.select("id", "margins"), keys(sample), classes, n, percent)
    linked = materialise(labels.join(classes, "id").select("id", "component", "head"), "near-linked")
    smallest = materialise(linked.groupBy("component").agg(F.min("head").alias("first"), F.count(F.lit(1)).alias("members")), "near-first")
    linked = lookup(linked.select("id", "component"), smallest, "component", "members", linked.count()).select("id", "first")
    named = materialise(classes.join(linked, "id", "left").select("id", F.coalesce("first", "head").alias("head"), "copies"), "near-named")
    return lookup(sets, named, "id", "copies", sets.count()).select("doc_id", "th", "n_shingles", "head")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row."""
    found = near_groups(docs, n, percent, id_col, text_col)
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, all columns, of each component's first row (see above) and of empty sets.

    Texts that no dropped row has stay where they are; only the others are shuffled.
    """
    found = near_groups(docs, n, percent, id_col, text_col).filter("n_shingles > 0 AND NOT (doc_id <=> head.doc_id AND th = head.th)")
    keys = [fresh(docs, k) for k in ("near_id", "near_lost", "near_text")]

    def key(i, th) -> list:
        return [F.coalesce(i, F.lit(0)).alias(keys[0]), i.isNull().alias(keys[1]), th.alias(keys[2])]

    weight = fresh(docs, "near_rows")
    gone = materialise(found.select(*key(F.col("doc_id"), F.col("th"))).groupBy(*keys).agg(F.count(F.lit(1)).alias(weight)), "near-gone")
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    some, others = KeyFilter(gone.select(keys[2]), keys[2]).split(docs, th)
    some = some.select("*", *key(F.col(id_col).cast("long"), th))
    total = int(gone.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0])
    kept = lookup(some, gone, keys, weight, total).filter(F.col(weight).isNull())
    return others.unionByName(kept.select(*docs.columns))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)


def oracle_sql(n: int = 4, percent: int = 85) -> str:
    from tidewater.llm.url_filters import LOWER, UPPER

    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))) END AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT p.b, r.c FROM r JOIN p ON r.id = p.a WHERE r.c < p.b)
SELECT doc_id, len(g) AS n_shingles, c AS component_id FROM s JOIN (SELECT id, min(c) AS c FROM r GROUP BY 1) ON id = doc_id
"""


ORACLE_SQL = oracle_sql()
