"""Byte-level BPE ids through the tokenizers library, with bounded caches of text units.

A byte-level BPE with the usual pre-tokenizer never joins text across a single space or
newline that stands between two characters that are not white space.  Texts are therefore cut
at those places into units: ``word`` after a space, ``\\nword`` after a newline or at the start.
Arrow cuts a slice of texts, finds its distinct units and lays their ids out in order; Python
sees distinct units only.  Ids of units stay in two generations of at
most about ``CACHE_UNITS`` entries each in every worker process.  Texts for which
the rule does not hold (other white space beside a cut, special tokens) go to the library whole.
"""

from __future__ import annotations

import os
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_UNITS, SLICE_BYTES = 200_000, 4_000_000
_TEXT = pa.large_string()
#: Characters that count as white space for the pre-tokenizer, and those that Python's isspace adds, as a class of RE2.
_WHITE = r"\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LOOSE = rf" [ \n{_WHITE}]|[\n{_WHITE}] |\n[{_WHITE}]|[{_WHITE}]\n|\n\n\n|\A[ \n{_WHITE}]|[ \n{_WHITE}]\z"


def default_tokenizer() -> str:
    """Path of the public vocabulary file; callers may pass any other path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_CHARS = _byte_chars()
SPACE, BEYOND = BYTE_CHARS[32], "\u0250"  # letters below BEYOND need no look at the library's tables


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class UnitEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids; one instance per tokenizer file and process."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.newline = self.whole("\n")
        self.marks = {c: self.whole(c) for c in ",.;:!?"}

    def whole(self, text: str) -> bytes:
        return _packed(self.library.encode(text, add_special_tokens=False).ids)

    def _learn(self, unit: str) -> bytes:
        """Ids of a unit that the newer generation lacks."""
        ids = self.old.get(unit)
        if ids is None:
            line = unit[:1] == "\n"
            word = unit[1:] if line else unit
            if word.isascii() and word.isalpha():  # one pre-token
                ids = _packed([t.id for t in self.model.tokenize(word if line else SPACE + word)])
            elif word.isalpha() and max(word) < BEYOND:
                ids = _packed([t.id for t in self.model.tokenize((word if line else " " + word).encode().decode("latin-1").translate(BYTE_CHARS))])
            else:
                ids = self.whole(word if line else " " + word)
            if line:
                ids = self.newline + ids
        self.new[unit] = ids
        return ids

    def _ids(self, units: list[str]) -> list[bytes]:
        """Ids of distinct units; a mark after a plain word is added to the word's ids, which the cache keeps."""
        if len(self.new) + len(units) > CACHE_UNITS:
            self.new, self.old = {}, self.new
        get, learn, marks, out = self.new.get, self._learn, self.marks, []
        for unit in units:
            if (ids := get(unit)) is None:
                mark = marks.get(unit[-1:])
                if mark is None or not (word := unit[:-1]).isalpha() or not (word.isascii() or max(word) < BEYOND):
                    ids = learn(unit)
                else:
                    ids = (get(word) or learn(word)) + mark
            out.append(ids)
        return out

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the offsets of each text in them; null counts as empty."""
        texts = pc.fill_null(texts.cast(_TEXT), "")
        bounds = np.frombuffer(texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, dtype=np.int64)
        ids, sizes, at = [], [], 0
        while at < len(texts):  # slices bound what very long texts add at once
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, side="right")) - 1)
            part, n = self._slice(texts.slice(at, to - at))
            ids.append(part)
            sizes.append(n)
            at = to
        pa.default_memory_pool().release_unused()  # workers outlive their tasks
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        if sizes:
            np.cumsum(np.concatenate(sizes), out=offsets[1:])
        return (np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)), offsets

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        loose = pc.match_substring_regex(texts, _LOOSE)
        for s in self.special:
            loose = pc.or_(loose, pc.match_substring(texts, s))
        plain = pc.if_else(loose, "", texts)
        cut = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\n", _TEXT), pc.replace_substring(plain, "\n", " \n"), pa.scalar("", _TEXT)), " ")
        units = cut.flatten().dictionary_encode()
        laid = pa.array(self._ids(units.dictionary.to_pylist()), pa.large_binary()).take(units.indices)
        places = np.frombuffer(laid.buffers()[1], "<i8", len(laid) + 1) // 4
        data = np.frombuffer(laid.buffers()[2], "<u4") if len(laid) and places[-1] else np.zeros(0, dtype=np.uint32)
        first = places[np.asarray(cut.offsets) - cut.offsets[0].as_py()]
        keep = np.ones(places[-1], dtype=bool)
        keep[first[:-1]] = False  # the newline put before each text
        sizes, data = np.diff(first) - 1, data[: places[-1]][keep]
        if pc.any(loose).as_py():
            each = np.split(data, np.cumsum(sizes)[:-1])
            for i in np.flatnonzero(np.asarray(loose)):
                each[i] = np.frombuffer(self.whole(texts[int(i)].as_py()), "<u4")
                sizes[i] = len(each[i])
            data = np.concatenate(each)
        return data, sizes

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each whole text; None counts as empty."""
        ids, offsets = self.encode_array(pa.array(texts, _TEXT))
        return [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The process's encoder for this tokenizer file."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]
