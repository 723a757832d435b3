"""Whole texts to token ids with the tokenizers library, common units of text once.

A text is cut into units (a run of white space and what follows it) at places
where the library's own pre-tokeniser always cuts, so the ids of a text are the
ids of its units in turn.  A worker keeps the ids of the commonest units it has
met (HOT of them, learnt from the first texts, relearnt when they stop
fitting).  The other units of a slice, run together in Arrow's buffer as they
are, go to the library in bulk; as each token stands for a known number of
bytes, running sums tell the units' ids apart again, and runs where these
disagree are encoded unit by unit.  All steps but the library's are Arrow and
numpy on whole slices, and memory is bounded by the slice and HOT.

Tokenizers that drop white space and never join letters, digits and marks have
smaller units: runs of one of these kinds (_CUTS), which recur far more often.
There a slice's other units go to the library once each, in bulk where all
their characters keep their number of bytes (_STEADY), else one by one; texts
that hold an added token are given to it whole.

Of the others, texts in which a cut would follow anything but a plain printable
character, and all texts of tokenizers of another build, are given to the
library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from tidewater.llm.common import slices  # noqa: F401  for those who encode

HOT = 400_000
LEARN_BYTES = 192 << 20
SLICE_BYTES = 6 << 20
RUN_BYTES = 16 << 10
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # the pattern that _CUTS holds for
_SAFE = "!-~¡-ᙿ"
_STEADY = "!-~À-ÖØ-öø-ÿЀ-џ一-鿿"
# kinds of bytes: white space, letters (ASCII, and U+00C0 to U+00FF in kinds_of), digits, marks, the apostrophe, and all that may join any neighbour
_SPACE, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _OTHER = range(6)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = _SPACE
_KINDS[33:127] = [_LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _MARK for c in range(33, 127)]
_KINDS[ord("'")] = _APOSTROPHE
# whether a unit starts at a byte, by 8 * the kind before it + its own; an apostrophe may make one word with the letters behind it
_CUTS = np.zeros(48, bool)
_CUTS[[8 * _SPACE + k for k in range(_LETTER, _OTHER + 1)]] = True
_CUTS[[8 * a + b for a in (_LETTER, _DIGIT) for b in (_LETTER, _DIGIT, _MARK, _APOSTROPHE) if a != b]] = True
_CUTS[[8 * _MARK + _LETTER, 8 * _MARK + _DIGIT, 8 * _APOSTROPHE + _DIGIT]] = True


def gather(blob: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs blob[start : start + length], one after another."""
    total = int(lengths.sum())
    at = np.cumsum(lengths) - lengths
    return blob[np.repeat(starts - at, lengths) + np.arange(total)]


def _composed(texts: pa.Array) -> pa.Array:
    """NFC of the texts that aren't in it yet."""
    plain = texts.to_pylist()
    if all(t.isascii() or unicodedata.is_normalized("NFC", t) for t in plain):
        return texts
    return pa.array([unicodedata.normalize("NFC", t) for t in plain], pa.string())


def _parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each starts, and the end) of a string column without nulls, as they lie in its buffers."""
    _, edges, blob = texts.buffers()
    edges = np.frombuffer(edges, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    blob = np.frombuffer(blob, np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
    return blob, edges - edges[0]


def kinds_of(blob: np.ndarray) -> np.ndarray:
    kinds = _KINDS[blob]
    led = np.flatnonzero(blob == 0xC3)
    led = led[(blob[led + 1] != 0x97) & (blob[led + 1] != 0xB7)]  # the signs of multiplication and division
    kinds[led] = kinds[led + 1] = _LETTER
    return kinds


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(units without white space, number of units before each text and in all) of a string column without nulls."""
    blob, edges = _parts(texts)
    kinds = kinds_of(blob)
    first = np.empty(len(blob), bool)
    first[:1] = True
    first[1:] = _CUTS[kinds[:-1] << 3 | kinds[1:]]
    first[edges[:-1][edges[:-1] < len(blob)]] = True
    kept = kinds != _SPACE
    first &= kept
    data = blob[kept]
    starts = np.append(np.flatnonzero(first[kept]), len(data)).astype(np.int32)
    units = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data))
    return units, np.searchsorted(np.flatnonzero(first), edges)


class UnitEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        plain = model["type"] == "BPE" and not model.get("dropout") and not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) for x in spec["added_tokens"])
        self.kind = ""
        if plain and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind, self.space = "bytes", r" \n"
        elif plain and suffix and [x["type"] for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [(x["type"], x.get("behavior"), x.get("invert")) for x in pre.get("pretokenizers", [])][:1] == [("Split", "Removed", True)] and pre["pretokenizers"][0]["pattern"] == {"Regex": WORDS}:
            self.kind = "words"
        self.bulk = self.tokenizer
        if self.kind == "words":  # the same model without a normaliser, whose work is done before
            self.bulk = Tokenizer(self.tokenizer.model)
            self.bulk.pre_tokenizer = self.tokenizer.pre_tokenizer
        self.added = [x["content"] for x in spec["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # one character of a token stands for one byte
        self.token_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, at in vocabulary.items():
            self.token_bytes[at] = len(token) - (len(suffix) if suffix and token.endswith(suffix) else 0)
        self._forget()

    def _forget(self) -> None:
        first = ["", "\n", " ", "\n\n", " \n"] if self.kind else [""]
        self.learning, self.seen = True, 0
        self._keep(pa.array(first), *self._flat(self._library(first)))

    def _keep(self, units: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.hot, self.hot_ids, self.hot_lengths = units, ids, lengths
        self.hot_starts = np.cumsum(lengths) - lengths

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([i for x in found for i in x], np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _bulk(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of units that each start with white space (words: one line feed) and end in a printable character."""
        units = pa.concat_arrays([units])  # its buffer then holds these units alone
        edges = units.offsets.to_numpy().astype(np.int64) if hasattr(units, "offsets") else np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1].astype(np.int64)
        raw = units.buffers()[2].to_pybytes() if units.buffers()[2] is not None else b""
        cuts = np.unique(np.append(np.searchsorted(edges, np.arange(edges[0], edges[-1], RUN_BYTES)), len(units)))
        cuts = np.unique(np.append(0, cuts))
        runs = [raw[edges[a] : edges[b]].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        sizes = np.diff(edges) - (self.kind == "words")  # without the white space
        parts, lengths = [], np.zeros(len(units), np.int64)
        for e, a, b in zip(self.bulk.encode_batch_fast(runs, add_special_tokens=False), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            ids = np.array(e.ids, np.uint32)
            reach, want = np.cumsum(self.token_bytes[ids]), np.cumsum(sizes[a:b])
            ends = np.searchsorted(reach, want)
            if len(ids) and reach[-1] == want[-1] and np.array_equal(reach[ends], want):
                lengths[a:b] = np.diff(ends + 1, prepend=0)
            else:
                ids, lengths[a:b] = self._flat(self._library(units.slice(a, b - a).to_pylist()))
            parts.append(ids)
        return np.concatenate(parts), lengths

    def _learn(self, units: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Add the units met twice to the hot ones."""
        if not len(units):
            return
        coded = units.dictionary_encode()
        unit = coded.indices.to_numpy()
        first = np.full(len(coded.dictionary), -1)
        first[unit[::-1]] = np.arange(len(unit))[::-1]
        self._add(coded.dictionary, np.bincount(unit, minlength=len(first)), ids, (np.cumsum(lengths) - lengths)[first], lengths[first])

    def _add(self, units: pa.Array, counts: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Add those of the distinct units that were met twice, the commonest first; each has the ids from its start on."""
        often = np.flatnonzero((counts > 1) & (pc.binary_length(units).to_numpy(zero_copy_only=False) < 64))
        often = often[np.argsort(-counts[often], kind="stable")][: HOT - len(self.hot)]
        new = gather(ids, starts[often], lengths[often])
        self._keep(pa.concat_arrays([self.hot, units.take(pa.array(often))]), np.concatenate([self.hot_ids, new]), np.concatenate([self.hot_lengths, lengths[often]]))

    def _distinct(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) of distinct words in NFC: the ids of the steady ones, found in bulk and in lower case, then those of the others, found one by one."""
        odd = pc.match_substring_regex(units, f"[^{_STEADY}]")
        others, odd = units.filter(odd), odd.to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(units.filter(pa.array(~odd))).dictionary_encode()
        bulk = self._bulk(pc.binary_join_element_wise("\n", lower.dictionary, "")) if len(lower) else self._flat([])
        rest = self._flat(self._library(others.to_pylist()))
        lengths = np.concatenate([bulk[1], rest[1]])
        at = np.zeros(len(units), np.int64)
        at[~odd], at[odd] = lower.indices.to_numpy(), len(bulk[1]) + np.arange(len(others))
        return np.concatenate([bulk[0], rest[0]]), (np.cumsum(lengths) - lengths)[at], lengths[at]

    def _encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ready = _composed(texts)
        units, offsets = words(ready)
        code = pc.fill_null(pc.index_in(units, value_set=self.hot), -1).to_numpy(zero_copy_only=False)
        cold, hot = np.flatnonzero(code < 0), code >= 0
        lengths, starts = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        lengths[hot], starts[hot] = self.hot_lengths[code[hot]], self.hot_starts[code[hot]]
        all_ids = self.hot_ids
        if len(cold):
            coded = units.take(pa.array(cold)).dictionary_encode()
            unit = coded.indices.to_numpy()
            new_ids, new_starts, new_lengths = self._distinct(coded.dictionary)
            lengths[cold], starts[cold] = new_lengths[unit], len(all_ids) + new_starts[unit]
            all_ids = np.concatenate([all_ids, new_ids])
        ids, counts = gather(all_ids, starts, lengths), np.diff(np.append(0, np.cumsum(lengths))[offsets])
        odd = np.zeros(len(texts), bool)
        for x in self.added:
            for column in [texts] if ready is texts else [texts, ready]:
                odd |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
        ids, counts = self._whole(texts, odd, ids, counts)
        self.seen += texts.nbytes
        if self.learning and len(cold):
            self._add(coded.dictionary, np.bincount(unit, minlength=len(new_lengths)), new_ids, new_starts, new_lengths)
            self.learning = len(self.hot) < HOT and self.seen < LEARN_BYTES
        elif not self.learning and len(cold) > 0.5 * len(code):
            self._forget()
        return ids, counts

    def _whole(self, texts: pa.Array, odd: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) with the library's own for odd texts."""
        if not odd.any():
            return ids, counts
        rows = np.flatnonzero(odd).tolist()
        whole = dict(zip(rows, self._library([texts[k].as_py() for k in rows]), strict=True))
        reach = np.concatenate([[0], np.cumsum(counts)])
        parts = [np.array(whole[k], np.uint32) if k in whole else ids[reach[k] : reach[k + 1]] for k in range(len(texts))]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in turn, number of ids of each text); null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not self.kind:
            return self._flat(self._library(texts.to_pylist()))
        if self.kind == "words":
            return self._encode_words(texts)
        # so that every text starts with white space; a line feed is a token of its own
        led = pc.match_substring_regex(texts, f"^[^{self.space}]")
        ready = pc.if_else(led, pc.binary_join_element_wise("\n", texts, ""), texts)
        lists = pc.split_pattern(pc.replace_substring_regex(ready, f"([{self.space}]+)", "\x00\\1"), "\x00")
        flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        code = pc.fill_null(pc.index_in(flat, value_set=self.hot), -1).to_numpy(zero_copy_only=False)
        cold = np.flatnonzero(code < 0)
        odd = pc.match_substring(texts, "\x00").to_numpy(zero_copy_only=False)
        new_ids, new_lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(cold):
            units = flat.take(pa.array(cold))
            good = pc.match_substring_regex(units, f"^[{self.space}].*[{_SAFE}]$").to_numpy(zero_copy_only=False)
            if not good.all():
                odd[np.searchsorted(offsets, cold[~good], "right") - 1] = True
                cold, units = cold[good], units.filter(pa.array(good))
            if len(cold):
                new_ids, new_lengths = self._bulk(units)
        hot = code >= 0
        lengths, starts = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        lengths[hot], starts[hot] = self.hot_lengths[code[hot]], self.hot_starts[code[hot]]
        lengths[cold], starts[cold] = new_lengths, len(self.hot_ids) + np.cumsum(new_lengths) - new_lengths
        reach = np.concatenate([[0], np.cumsum(lengths)])
        ids, counts = gather(np.concatenate([self.hot_ids, new_ids]), starts, lengths), np.diff(reach[offsets])
        put = led.to_numpy(zero_copy_only=False) & ~odd  # the line feeds put before texts
        ids, counts = self._whole(texts, odd, np.delete(ids, reach[offsets[:-1]][put]), counts - put)
        self.seen += texts.nbytes
        if self.learning and len(cold):
            self._learn(units, new_ids, new_lengths)
            self.learning = len(self.hot) < HOT and self.seen < LEARN_BYTES
        elif not self.learning and len(cold) > 0.5 * len(code):
            self._forget()
        return ids, counts


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """This worker's encoder of that file; its hot units carry over from task to task."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def release_unused() -> None:
    """Give back what Arrow keeps of freed memory, as workers live on beside the JVM."""
    pa.default_memory_pool().release_unused()


def forget_encoders() -> None:
    """Drop this worker's encoders, in passes after the last that encodes: else it holds them for as long as it lives."""
    if _encoders:
        _encoders.clear()
        release_unused()
