"""Whole texts to token ids with the ``tokenizers`` library, encoding each distinct unit once.

The vocabulary drops white space and never merges across it, so a text's ids are those of its
white-space-separated chunks in order. Where the library's own settings are those of ``_RULES``, it also
lower-cases and never merges letters with marks, so a chunk of letters below U+02B0, with or without ASCII
marks after them, is two units: its letters, A-Z lower-cased, and its marks. (U+0130 is none of these
letters: its lower case is two characters.) Other chunks are one unit. Distinct units are encoded by the
library in one call: letters end at each id of an ending token, others stand between separators; units
that hold the separator or a special token's start are encoded alone.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from foliowash.llm.bytewords import slices

END_ID = 1
_SEPARATOR = "\x01"
_AT_ONCE = 20_000
_LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{2AF}"
# without ' < | >, of which contractions and special tokens are made
_MARKS = r"!-&(-/:;=?@\[-`{}~"
_UNITS = rf"^(?P<letters>[{_LETTERS}]+)(?P<marks>[{_MARKS}]*)$"
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The normalizer and pre-tokenizer for which chunks can be cut into units, and the end of each word's last token.
_RULES = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
    "</w>",
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _taken(flat: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges of ``flat`` that ``place`` names by their number in the bounds ``at``, and their n+1 bounds."""
    start = at[place]
    size = at[place + 1] - start
    total = np.concatenate([[0], np.cumsum(size)])
    narrow = np.int32 if max(len(flat), total[-1]) < 1 << 31 else np.int64
    take = np.repeat((start - total[:-1]).astype(narrow), size)
    take += np.arange(total[-1], dtype=narrow)
    return flat[take], total


class Encoder:
    """Keeps the ids of distinct units between calls, up to ``cache`` bytes: those seen first, which the most
    frequent ones are among. Results do not depend on it."""

    def __init__(self, path: str, cache: int = 12 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.cache = cache
        self.known = pa.array([], pa.large_string())
        self.ids = np.empty(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)
        self.separator = self._plain(_SEPARATOR)
        if len(self.separator) != 1:
            raise ValueError("this vocabulary has no single id for the separator")
        self.cuts = self._rules() == _RULES
        vocabulary = self.library.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ending[[k for x, k in vocabulary.items() if x.endswith(_RULES[2])]] = True

    def _rules(self):
        steps = [json.loads(x.__getstate__()) if x is not None else {} for x in (self.library.normalizer, self.library.pre_tokenizer)]
        return steps[0].get("normalizers"), steps[1].get("pretokenizers"), getattr(self.library.model, "end_of_word_suffix", None)

    def _plain(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _encode_new(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, and their bounds."""
        plain = np.zeros(len(units), dtype=bool)
        if self.cuts:
            plain = pc.match_substring_regex(units, f"^[{_LETTERS}]+$").to_numpy(zero_copy_only=False)
        names = units.filter(pa.array(plain)).to_pylist()
        parts, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for k in range(0, len(names), _AT_ONCE):  # the library's result is large, so not all at once
            group = names[k : k + _AT_ONCE]
            flat = self._joined(group, " ")
            size = np.diff(np.flatnonzero(self.ending[flat]), prepend=-1)
            if len(size) != len(group) or size.sum() != len(flat):
                raise RuntimeError("ends of words and units differ in number")
            parts.append(flat)
            sizes.append(size)
        flat, size = self._encode_odd(units.filter(pa.array(~plain)))
        flat, size = np.concatenate([*parts, flat]), np.concatenate([*sizes, size])
        # from the plain ones and then the others to the order of the units
        order = np.empty(len(units), np.int64)
        order[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(units))
        return _taken(flat, np.concatenate([[0], np.cumsum(size)]), order)

    def _joined(self, group: list[str], between: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([between.join([*group, ""])], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def _encode_odd(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks of any kind, and the number of each."""
        odd = pc.or_(pc.match_substring(chunks, "<|"), pc.match_substring(chunks, _SEPARATOR)).to_numpy(zero_copy_only=False)
        names = chunks.to_pylist()
        if odd.any():
            alone = {i: self._plain(names[i]) for i in np.flatnonzero(odd).tolist()}
            names = ["" if i in alone else x for i, x in enumerate(names)]
        else:
            alone = {}
        parts, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for k in range(0, len(names), _AT_ONCE):
            group = names[k : k + _AT_ONCE]
            flat = self._joined(group, f" {_SEPARATOR} ")
            ends = np.flatnonzero(flat == self.separator[0])
            if len(ends) != len(group):
                raise RuntimeError("separators and chunks differ in number")
            sizes.append(np.diff(ends, prepend=-1) - 1)
            parts.append(np.delete(flat, ends))
        flat, size = np.concatenate(parts), np.concatenate(sizes)
        for i, ids in alone.items():
            at = int(size[:i].sum())
            flat = np.concatenate([flat[:at], np.array(ids, dtype=np.uint32), flat[at:]])
            size[i] = len(ids)
        return flat, size

    def _units(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct units, the units of all chunks in order, and n+1 bounds of each chunk's."""
        if not self.cuts:
            return chunks, np.arange(len(chunks)), np.arange(len(chunks) + 1)
        cut = pc.extract_regex(chunks, _UNITS)
        letters, marks = (pc.struct_field(cut, k).cast(pa.large_string()) for k in (0, 1))
        odd = pc.is_null(cut)
        first = pc.if_else(odd, chunks, pc.ascii_lower(letters))
        two = pc.and_(pc.invert(odd), pc.greater(pc.binary_length(marks.fill_null("")), 0))
        coded = pa.concat_arrays([first, marks.filter(two)]).dictionary_encode()
        code, two = np.asarray(coded.indices), two.to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(1 + two)])
        out = np.empty(bounds[-1], np.int64)
        out[bounds[:-1]], out[bounds[1:][two] - 1] = code[: len(chunks)], code[len(chunks) :]
        return coded.dictionary.cast(pa.large_string()), out, bounds

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (nulls: empty) as uint32, and n+1 bounds; ``end_id`` closes each text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        lists = pc.ascii_split_whitespace(texts)
        first = np.asarray(lists.offsets)
        coded = lists.flatten().dictionary_encode()
        code = np.asarray(coded.indices)
        units, inner, cut = self._units(coded.dictionary.cast(pa.large_string()))
        place = pc.index_in(units, value_set=self.known)
        new = units.filter(pc.is_null(place))
        place = np.asarray(place.fill_null(-1)).astype(np.int64)
        flat, at = self.ids, self.bounds
        if len(new):
            ids, bounds = self._encode_new(new)
            place[place < 0] = len(self.known) + np.arange(len(new))
            flat, at = np.concatenate([flat, ids]), np.concatenate([at, at[-1] + bounds[1:]])
            if self.known.nbytes + new.nbytes + flat.nbytes + at.nbytes <= self.cache:
                self.known, self.ids, self.bounds = pa.concat_arrays([self.known, new]), flat, at
        # of units, of chunks, of texts
        flat, at = _taken(flat, at, place[inner])
        at = at[cut]
        out, total = _taken(flat, at, code)
        bounds = total[first - first[0]]
        if end_id is not None:
            out = np.insert(out, bounds[1:], np.uint32(end_id))
            bounds = bounds + np.arange(len(bounds))
        return out, bounds

    def runs(self, texts: pa.Array, limit: int = 4 << 20):
        """(from, to, ids, bounds) of row ranges of at most ``limit`` bytes of text, or one row."""
        for i, j in slices(texts, limit):
            yield i, j, *self.encode(texts[i:j])


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache: int = 12 << 20) -> Encoder:
    """One per worker, vocabulary file and size of cache."""
    if (path, cache) not in _ENCODERS:
        _ENCODERS[path, cache] = Encoder(path, cache)
    return _ENCODERS[path, cache]
