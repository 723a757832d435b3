"""Importance resampling, line deduplication and fill-in-middle against brute force; odd inputs for all."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import fill_middle, importance, line_dedup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def hex_of(seed, i):
    return hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()


# importance resampling


def brute_runs(text, n):
    w = WORD.findall(text.translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute_importance(rows, target, n, buckets, percent, seed, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    runs = [brute_runs(t, n) for _, t in rows]
    s = collections.Counter(bucket(f) for _, fs in runs for f in fs)
    t = collections.Counter(bucket(f) for x in target for f in brute_runs(x, n)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (words, fs) in zip(rows, runs, strict=True):
        w = sum(gain[bucket(f)] for f in fs)
        out.append([i, words, len(fs), w, w + math.floor(-1000 * math.log(-math.log((int(hex_of(seed, i)[:8], 16) + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[5] = rank
    return out


def sortable(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("n,size", [(1, 100_000), (1, 40), (3, 40), (3, 1000)])
def test_chunks_own_every_run(n, size, odd):
    rng = random.Random(n * size)
    texts = ["", "a", "  a", "word " * 50, "x" * 300 + " y", "tail  ", "ÄÖ ü" * 30] + ["".join(rng.choice("ab cDé .\n9") for _ in range(rng.randrange(400))) for _ in range(40)]
    bucketer = importance.Bucketer(1 << 32)
    for text in texts:
        places = list(importance.chunk_places(text, n, size))
        assert [a for a, _, _ in places] == [0, *(o for _, o, _ in places)][: len(places)] and (not text or places[-1][1] == len(text))
        found = collections.Counter()
        for start, owned, end in places:
            found.update(bucketer.features(text[start:end], owned - start, n)[1].tolist())
        assert found == collections.Counter(zlib.crc32(f.encode()) for f in brute_runs(text, n)[1])
        assert all(end - start <= size + 400 for start, _, end in places)


@pytest.mark.parametrize("n,size,buckets", [(1, 100_000, 10_000), (3, 500, 997)])
def test_importance_against_brute_force(spark, sf, documents, n, size, buckets):
    target = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = importance.importance_sample(documents, target, 10, 2024, 20, n, buckets, size).collect()
    want = brute_importance(rows_of(documents), [r.text or "" for r in target.collect()], n, buckets, 10, 2024, 20)
    assert sortable((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got) == sortable(want)


def test_importance_of_odd_rows(spark, odd, none):
    target = spark.createDataFrame([("number5 same text",), (None,)], "text string")
    got = importance.importance_sample(odd, target, 100, 1, 3, 2, 50, size=1000).collect()
    rows = rows_of(odd)
    want = brute_importance(rows, ["number5 same text", ""], 2, 50, 100, 1, 3)
    assert sortable((r.doc_id, r.n_features, r.weight, r.score) for r in got) == sortable((r[0], r[2], r[3], r[4]) for r in want)
    ranks = sorted(r.rank for r in got if r.rank is not None)
    assert ranks == list(range(1, sum(r[1] >= 3 for r in want) + 1))
    assert [r.rank for r in got if r.doc_id == 0] == [None] and [r.weight for r in got if r.doc_id in (0, 1, 2)] == [0, 0, 0]
    assert importance.importance_sample(none, target).count() == 0
    # against an empty target all gains come from the smoothing
    assert {r.weight for r in importance.importance_sample(odd, target.limit(0), min_words=0).collect() if r.doc_id == 1} == {0}


def test_target_words_win(spark):
    rows = [(i, ("quantum lattice photon " if i % 10 == 0 else "plain common words ") * 10) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    drawn = importance.importance_sample(docs, spark.createDataFrame([("quantum lattice photon",)], "text string")).filter("rank IS NOT NULL").collect()
    assert len(drawn) == 20 and all(r.doc_id % 10 == 0 for r in drawn)


# line deduplication


def brute_lines(rows, docs, chars):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    holders = collections.defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= chars:
                holders[k].append(i)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in holders.items() if len(ids) >= docs}
    out = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_rows(df):
    return sortable((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect())


@pytest.mark.parametrize("share", [1000, 1, 10**9])  # as is, no key in the broadcast shard, every key in it
def test_lines_against_brute_force(spark, documents, monkeypatch, share):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    assert line_rows(line_dedup.drop_repeated_lines(documents)) == sortable(brute_lines(rows_of(documents), 3, 20))


@pytest.mark.parametrize("share", [1000, 1])
def test_lines_of_odd_rows(spark, odd, none, monkeypatch, share):
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    line = "a line that stands in many documents"
    more = [
        (20, f"x\n{line}\n{line}\ny"), (21, f"\t{line.upper()} \r"), (22, f"{line}\n\nend\n"), (22, f"{line}\n\nend\n"), (23, "\n\n"), (24, f"{line} \n{line}İ"),
        (None, "one that only rows without id hold\nb"), (None, "one that only rows without id hold\nc"), (None, "One that only rows without id hold\nd"),
        (None, line), (30, "19 code points: éééé"[:19]), (31, "19 code points: éééé"[:19]), (32, "19 code points: éééé"[:19]), (33, "20 code points: ääää"), (34, "20 code points: ääää"), (35, "20 code points: ÄÄÄÄ\n20 Code points: ääää"),
    ]
    docs = odd.select("doc_id", "text", "keep_id").unionByName(spark.createDataFrame([(*r, "k") for r in more], "doc_id long, text string, keep_id string"))
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert line_rows(got) == sortable(brute_lines(rows_of(docs), 3, 20))
    told = collections.defaultdict(list)
    for r in got.collect():
        told[r.doc_id].append(r)
    assert told[20][0].text == "x\ny" and told[21][0].text == "" and [r.n_dropped for r in told[22]] == [0, 0]
    assert sum(r.n_dropped for r in told[None]) == 1 and told[33][0].n_dropped == 1 and told[30][0].n_dropped == 0
    assert (told[0][0].text, told[0][0].n_lines) == ("", 1)
    assert line_dedup.drop_repeated_lines(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 60_000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
    if n > 2:
        h1[1], h1[2] = h1[0], h1[0]  # one word alone doesn't tell these apart
    mph = line_dedup.MinimalPerfectHash.build(h1, h2)
    assert sorted(mph.slots(h1, h2).tolist()) == list(range(n))
    assert 64 * len(mph.bits) <= 3.2 * n + 640
    shard = line_dedup.Shard.unpacked(line_dedup.Shard.build(h1, h2, np.arange(n), pa.array(range(n), pa.int64())).packed())
    ids, named = np.arange(n), np.ones(n, bool)
    assert not shard.lost(h1, h2, ids, named).any() and shard.lost(h1, h2, ids + 1, named).all() and shard.lost(h1, h2, ids, ~named).all()
    other = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    assert not shard.lost(*other, np.zeros(5000, np.int64), np.ones(5000, bool)).any()
    assert (shard.counts[shard.mph.slots(h1, h2)] == ids).all()


# fill-in-middle


def brute_middle(i, text, seed=7, percent=100, spm=50, unit=r"[^\n]*\n|[^\n]+", markers=("<P>", "<S>", "<M>")):
    units = [m.group() for m in re.finditer(unit, text)]
    h = [int(hex_of(seed, i)[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in markers) or h[2] % 100 >= percent:
        return (i, len(units), "plain", None, None, None, text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    x, y, z = markers
    return (i, len(units), form, p, m, s, x + p + y + s + z + m if form == "psm" else y + s + x + p + z + m)


def middle_rows(df):
    return sortable((r.doc_id, r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in df.collect())


def test_middle_of_odd_rows(spark, odd, none):
    e, d = fill_middle.ESCAPE, fill_middle.DELIMITER
    odds = [f"{e}", f"{d}", f"{e}0{d}1\n{e}1{d}{d}0\n{e}{e}{d}", "a <S> b\nc", "<<S\n<P\n>x<M", "\n\n\n", "\r\n x\n\x85y\x00\n", "$0\n$1\\0\n", "no line feed", "last\n", "🙂\n日本\n", "<P>"]
    rows = [(1000 + 50 * k + j, t) for k, t in enumerate(odds) for j in range(25)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    for percent, spm, unit in ((100, 50, fill_middle.LINES), (40, 0, "[^ ]* |[^ ]+")):
        made = fill_middle.fill_in_middle(docs, percent=percent, spm_percent=spm, unit=unit)
        assert middle_rows(made) == sortable(brute_middle(i, t, 7, percent, spm, unit) for i, t in rows_of(docs))
        assert all(r.back == r.text for r in made.select("text", fill_middle.restore(F.col("output"), F.col("form")).alias("back")).collect())
    assert fill_middle.fill_in_middle(none).count() == 0


def test_middle_stays_in_the_jvm(spark, documents):
    plan = fill_middle.fill_in_middle(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_middle_query(spark, sf, texts):
    from tidewater.llm.queries import QUERIES

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in QUERIES["op13_fill_in_middle"](spark, sf).collect():
        want = brute_middle(r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.output_sha256, r.restored_sha256) == (want[1], want[2], sha(want[6]), sha(texts[r.doc_id]))
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if want[2] == "plain" else (len(want[3]), len(want[4])))


def test_scratch_folder_without_a_setting(spark, monkeypatch, tmp_path):
    """A local session that names no folder gets one of its own, the same for all its tables."""
    from tidewater.llm import common

    named = spark.conf.get("spark.checkpoint.dir", None)

    class Unnamed:
        sparkContext = spark.sparkContext

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    assert common.scratch_root(Unnamed()) == common.scratch_root(Unnamed()) and "checkpoints-" in common.scratch_root(Unnamed())
    assert spark.conf.get("spark.checkpoint.dir", None) == named
