"""Quality rules from repetition coverage.

Per document, words become integers and rolling polynomial hashes over several
n-gram lengths are kept in numpy arrays; sorting each length's hashes marks the
n-grams that occur twice or more, and the characters of the words they cover
are counted.  Lines are measured likewise.  A document fails when too large a
share of its characters lies inside repeated n-grams or lines, or when symbols
outweigh words.

Row-local: no shuffle, one pass, memory of one slice of texts.  Defined
results: null or empty text has no words and fails the base rule; ties, repeated
rows and rows without an id are judged row by row; an empty table gives an
empty result; extra columns are not read; a very long text is measured whole,
with memory for its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import id_text, pieces, table

WORD = re.compile(r"[^ \t-\r]+")
SYMBOLS = "#*$%&|<>"
BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limits:
    """Largest share of word characters inside repeated n-grams, by length; other shares."""

    ngrams: tuple[tuple[int, float], ...] = ((3, 0.50), (4, 0.50), (5, 0.45), (7, 0.45), (10, 0.45))
    dup_line_chars: float = 0.45
    dup_lines: float = 0.30
    symbols_per_word: float = 0.10
    shouts_per_word: float = 0.25
    min_words: int = 50
    max_repeat_percent: int = 50


LIMITS = Limits()
LENGTHS = tuple(n for n, _ in LIMITS.ngrams)


def _repeated(h: np.ndarray) -> np.ndarray:
    """Which entries occur twice or more."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    out = np.zeros(len(h), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _covered(starts: np.ndarray, n: int, words: int) -> np.ndarray:
    edge = np.zeros(words + 1, np.int32)
    edge[: len(starts)] += starts
    edge[n : n + len(starts)] -= starts
    return np.cumsum(edge[:-1]) > 0


def measure(text: str, lengths: tuple[int, ...] = LENGTHS) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, n_lines, shouts, shares by length."""
    words = WORD.findall(text)
    n = len(words)
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n)
    sizes = np.fromiter(map(len, words), np.int64, n)
    chars = int(sizes.sum())
    repeat = 0
    shares = [0.0] * len(lengths)
    if n >= 3:
        # ids stay under 2**21 for any text below two million distinct words; beyond it, renumber pairs
        if len(seen) < 1 << 21:
            triple = ids[:-2] << np.uint64(42) | ids[1:-1] << np.uint64(21) | ids[2:]
        else:
            pair = np.unique(ids[:-1] << np.uint64(32) | ids[1:], return_inverse=True)[1].astype(np.uint64)
            triple = pair[:-1] << np.uint64(32) | ids[2:]
        dup3 = _repeated(triple)
        if dup3.any():
            cover = _covered(dup3, 3, n)
            repeat = int(cover.sum())
            mixed = (ids + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(31)
            h, size = mixed, 1
            for k, length in enumerate(lengths):
                if length == 3:
                    shares[k] = int(sizes[cover].sum()) / chars
                if n < length:
                    break
                while size < length:
                    h, size = h[:-1] * BASE + mixed[size:], size + 1
                if length != 3:
                    dup = _repeated(h)
                    if not dup.any():  # no longer n-gram repeats either
                        break
                    shares[k] = int(sizes[_covered(dup, length, n)].sum()) / chars
    lines = text.split("\n")
    dup_lines = line_chars = full = 0
    earlier: set[str] = set()
    if len(lines) > 1:
        for line in lines:
            if WORD.search(line):
                full += 1
                if line in earlier:
                    dup_lines += 1
                    line_chars += len(line)
                earlier.add(line)
    else:
        full = int(n > 0)
    return n, chars, sum(map(text.count, SYMBOLS)), dup_lines, repeat, line_chars, full, text.count("!!"), shares


def judge(text: str, limits: Limits = LIMITS) -> tuple:
    n, chars, symbols, dup_lines, repeat, line_chars, lines, shouts, shares = measure(text, tuple(x for x, _ in limits.ngrams))
    failed = n < limits.min_words or 100 * repeat > limits.max_repeat_percent * n
    kept = not failed and not (
        any(s > most for s, (_, most) in zip(shares, limits.ngrams, strict=True))
        or line_chars > limits.dup_line_chars * len(text)
        or dup_lines > max(1, limits.dup_lines * lines)
        or symbols > limits.symbols_per_word * n
        or shouts > limits.shouts_per_word * n
    )
    return n, chars, symbols, dup_lines, repeat, failed, kept, shares


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ngram_shares array<double>"


def quality_rules(docs: DataFrame, limits: Limits = LIMITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of every document, the share of characters in repeated n-grams by length, and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in pieces(batch):
                cols = list(zip(*(judge(t, limits) for t in texts), strict=True))
                kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ngram_shares"])

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("ngram_shares")


def oracle_sql(limits: Limits = LIMITS) -> str:
    share = " OR ".join(f"(k = {n} AND c > {most} * chars)" for n, most in limits.ngrams)
    symbols = "[" + "".join("\\" + x for x in SYMBOLS) + "]"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT key, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT key, k, i, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM w, unnest([{", ".join(str(n) for n, _ in limits.ngrams)}]) AS v(k), unnest(range(1, len(ws) - k + 2)) AS u(i)),
d AS (SELECT key, k, i FROM (SELECT *, count(*) OVER (PARTITION BY key, k, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT DISTINCT key, k, i + o AS j FROM d, unnest(range(0, k)) AS x(o)),
s AS (SELECT key, k, count(*) AS n, sum(length(ws[j])) AS c FROM c JOIN w USING (key) GROUP BY 1, 2),
l AS (SELECT key, line, row_number() OVER (PARTITION BY key, line) AS nth FROM (SELECT key, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ln AS (SELECT key, count(*) AS lines, count(*) FILTER (nth > 1) AS dups, coalesce(sum(length(line)) FILTER (nth > 1), 0) AS dup_chars FROM l GROUP BY 1),
m AS (SELECT key, doc_id, length(text) AS size, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS chars, len(regexp_extract_all(text, '{symbols}')) AS n_symbols, (length(text) - length(replace(text, '!!', ''))) // 2 AS shouts FROM t JOIN w USING (key)),
f AS (SELECT m.*, coalesce(dups, 0) AS dups, coalesce(dup_chars, 0) AS dup_chars, coalesce(lines, 0) AS lines, coalesce(s.n, 0) AS repeats, EXISTS (SELECT 1 FROM s z WHERE z.key = m.key AND ({share})) AS covered FROM m LEFT JOIN ln USING (key) LEFT JOIN s ON s.key = m.key AND s.k = 3),
b AS (SELECT *, n_words < {limits.min_words} OR 100 * repeats > {limits.max_repeat_percent} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, chars AS word_chars, n_symbols, dups AS n_dup_lines, repeats AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (covered OR dup_chars > {limits.dup_line_chars} * size OR dups > greatest(1, {limits.dup_lines} * lines) OR n_symbols > {limits.symbols_per_word} * n_words OR shouts > {limits.shouts_per_word} * n_words) AS kept
FROM b
"""


ORACLE_SQL = oracle_sql()
