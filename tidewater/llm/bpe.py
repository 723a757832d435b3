"""Exact byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

Encoding a pre-token: an Aho-Corasick automaton of the whole vocabulary lists
every token ending at every place in one pass, which gives the longest token
from each place.  The encoder walks from the left, taking the longest token
whose pair with the one before it is compatible; where none is, it falls back
to the longest shorter token (the next prefix), and where those run out it
drops the last token and shortens it.  A pair is compatible if merging the two
tokens' bytes by rank gives just these two tokens, decided once by walking down
both tokens' merge trees and remembered in a table.  Places found to be dead
ends are marked, so each is left once and the walk is linear; its only
complete result is the one that merging by rank gives.

Pre-tokenisation (special tokens, NFC, lower case, word pattern) is done per
distinct word of ASCII-white-space-separated text, remembered by each worker up
to a bound.  Which characters are letters, numbers and white space differs
between Unicode versions, so the driver asks the library's pre-tokeniser once
about every code point, and words outside ASCII are put in normal form and
lower case by the library's own normalisers.  Decoding looks ids up in one byte
string with an offset table, in numpy, joined as the library joins tokens
without a decoder.

Row-local: no shuffle.  Defined results: null or empty text has no tokens and
decodes to the empty text; ids outside the vocabulary decode to nothing; rows
that repeat an id are each returned, also with a null id; an empty table gives
an empty result; extra columns are not read; a very long text is encoded whole,
with memory for its ids.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from tidewater.llm.common import id_text, table
from tidewater.llm.encoding import gather, slices

CACHE = 300_000
PIECES = 400_000
LONGEST = 48


def _ranges(points: np.ndarray) -> str:
    """Ascending code points as the inside of a character set."""
    if not len(points):
        return ""
    cuts = np.flatnonzero(np.diff(points) > 1)
    firsts, lasts = points[np.append(0, cuts + 1)], points[np.append(cuts, len(points) - 1)]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True))


@functools.lru_cache
def word_pattern(path: str) -> str:
    """The file's word pattern with its character classes spelled out as the library has them."""
    with open(path, encoding="utf-8") as f:
        pattern = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    cut = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
    every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    letters, numbers, spaces = [], [], []
    for at in range(0, len(every), 1 << 14):
        some = every[at : at + (1 << 14)]
        # a letter joins its neighbours, white space vanishes, a number stands alone, anything else joins itself
        found = cut.pre_tokenize_str("".join(f"a{c}{c}b\n" for c in map(chr, some.tolist())))
        ends = np.zeros(5 * len(some), np.int64)
        starts = np.fromiter((x[1][0] for x in found), np.int64, len(found))
        ends[starts] = np.fromiter((x[1][1] for x in found), np.int64, len(found))
        ends = ends.reshape(-1, 5) - 5 * np.arange(len(some))[:, None]
        letters.append(some[ends[:, 0] == 4])
        numbers.append(some[(ends[:, 0] == 1) & (ends[:, 1] == 2)])
        spaces.append(some[(ends[:, 0] == 1) & (ends[:, 1] <= 0)])
    for name, points in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", spaces)):
        pattern = pattern.replace(name, _ranges(np.concatenate(points)))
    return pattern


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class BacktrackingBpe:
    """Ids of one pre-token, given as vocabulary symbols (the last one may carry the word-end suffix)."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocabulary, self.suffix = vocabulary, suffix
        self.text = {i: t for t, i in vocabulary.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for k, (a, b) in enumerate(merges):
            left, right, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.rank[left, right] = (k, made)
            self.halves.setdefault(made, (left, right))
        self.automaton = ahocorasick.Automaton()
        # a word end is one symbol: written as a character that no token has
        for token, i in vocabulary.items():
            key = self._key(token)
            if len(key) == 1 or i in self.halves:
                self.automaton.add_word(key, (len(key), i))
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.width = {i: len(self._key(t)) for t, i in vocabulary.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    END = ""

    def _key(self, token: str) -> str:
        """One character for each symbol: a suffixed symbol is its character shifted into a private range."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + 0xE000)
        return token

    def _next_prefix(self, token: int) -> int:
        """The longest token that starts `token` and is shorter, or -1."""
        got = self.shorter.get(token)
        if got is None:
            key, got = self._key(self.text[token]), -1
            for n in range(len(key) - 1, 0, -1):
                if key[:n] in self.automaton:
                    got = self.automaton.get(key[:n])[1]
                    break
            self.shorter[token] = got
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the symbols of a and b by rank gives (a, b) and nothing else."""
        got = self.pairs.get((a, b))
        if got is None:
            got = self.pairs[a, b] = self._compatible(a, b)
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
        return got

    def _compatible(self, a: int, b: int) -> bool:
        rank, halves = self.rank, self.halves
        limit = 1 << 60  # rank of the merge that would have come before one across the seam
        while True:
            across = rank.get((a, b))
            if across is not None and across[0] < limit:
                return False
            # undo the later of the two last merges: the seam then saw that state before
            ra = rank[halves[a]][0] if a in halves else -1
            rb = rank[halves[b]][0] if b in halves else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, halves[a][1]
            else:  # of equal merges the left one comes first, so one across the seam precedes b's
                limit, b = rb + 1, halves[b][0]

    def encode(self, key: str) -> list[int]:
        n = len(key)
        whole = self.automaton.get(key, None)
        if whole is not None:
            return [whole[1]]
        longest = [-1] * n
        size = [0] * n
        for end, (width, token) in self.automaton.iter(key):
            start = end - width + 1
            if width > size[start]:
                size[start], longest[start] = width, token
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        width, compatible, shorter = self.width, self.compatible, self._next_prefix
        while True:
            while token >= 0:
                end = at + width[token]
                if alive[end] and (not out or compatible(out[-1], token)):
                    break
                token = shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            else:
                if not out:
                    raise ValueError(f"no encoding of {key!r}")
                alive[at] = 0
                token = out.pop()
                at -= width[token]
                token = shorter(token)


class WordTokenizer:
    """Encoder and decoder for a word-end BPE file, built from its vocabulary and merges alone."""

    def __init__(self, path: str, pattern: str):
        """pattern: word_pattern() of the same file."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, norm = spec["model"], spec["normalizer"]["normalizers"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or [x["type"] for x in norm] != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or spec["decoder"] is not None:
            raise ValueError("not a word-end BPE file of the known build")
        self.suffix = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.bpe = BacktrackingBpe(model["vocab"], merges, self.suffix)
        self.pattern = re.compile(pattern)
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(norm[1]["pattern"]["Regex"]), norm[1]["content"]), normalizers.Lowercase()]).normalize_str
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.symbols = byte_characters()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        tokens = {**model["vocab"], **self.special}
        width = max(tokens.values(), default=-1) + 1
        texts = [b""] * width
        for t, i in tokens.items():
            texts[i] = t.encode() + b" "
        self.sizes = np.fromiter(map(len, texts), np.int64, width)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(texts), np.uint8)

    def _piece(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            symbols = self.symbols
            key = piece if piece.isascii() and piece.isalpha() else "".join(symbols[b] for b in piece.encode())
            key = key[:-1] + chr(ord(key[-1]) + 0xE000)
            got = np.array(self.bpe.encode(key), "<u4").tobytes()
            if len(self.pieces) > PIECES:
                self.pieces.clear()
            if len(piece) <= LONGEST:
                self.pieces[piece] = got
        return got

    def _plain(self, word: str) -> bytes:
        if not word.isascii():
            word = self.normal(word)
        else:
            word = word.lower()
            if word.isalpha():
                return self._piece(word)
        return b"".join(map(self._piece, self.pattern.findall(word)))

    def _word(self, word: str) -> bytes:
        if self.special_cut is None or "<" not in word:
            return self._plain(word)
        out, at = [], 0
        for m in self.special_cut.finditer(word):
            out += [self._plain(word[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(word[at:])])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in turn, number of ids of each text); null counts as empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = lists.flatten().dictionary_encode()
        unit, distinct = flat.indices.to_numpy(), flat.dictionary.to_pylist()
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        known, word = self.words, self._word
        found = [known.get(w) for w in distinct]
        for k, x in enumerate(found):
            if x is None:
                found[k] = known[distinct[k]] = word(distinct[k])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        lengths = sizes[unit]
        reach = np.concatenate([[0], np.cumsum(lengths)])
        ids = gather(np.frombuffer(b"".join(found), "<u4"), (np.cumsum(sizes) - sizes)[unit], lengths)
        if len(known) > CACHE:
            often = np.bincount(unit, minlength=len(distinct)) > 1
            self.words = {w: x for w, x, keep in zip(distinct, found, often.tolist(), strict=True) if keep and len(w) <= LONGEST}
        return ids, np.diff(reach[offsets])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of runs of ids."""
        inside = ids < len(self.sizes)
        safe = np.where(inside, ids, 0).astype(np.int64)
        sizes = np.where(inside, self.sizes[safe], 0)
        body = gather(self.blob, self.places[safe], sizes)
        reach = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        # every token ends in a space; the text's last one goes
        ends = reach[1:][reach[1:] > reach[:-1]] - 1
        body = np.delete(body, ends)
        sizes = np.diff(reach) - (np.diff(reach) > 0)
        return pa.Array.from_buffers(pa.large_string(), len(counts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(body)]).cast(pa.string())


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str, pattern: str) -> WordTokenizer:
    """This worker's tokenizer of that file; its automaton, table and caches carry over from task to task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path, pattern)
    return _tokenizers[path]


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string."""

    pattern = word_pattern(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_tokenizer(tokenizer, pattern)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                ids, counts = own.encode(texts)
                reach = np.concatenate([[0], np.cumsum(counts)])
                column = pa.ListArray.from_arrays(pa.array(reach, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), column, own.decode(ids, counts)], ["doc_id", "ids", "decoded"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
