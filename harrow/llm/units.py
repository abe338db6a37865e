"""Encoding by units: stretches of text that a tokenizer treats alike wherever they stand.

A unit begins before ASCII white space that follows a character that is no white space, and before an ASCII mark that follows a letter. The
pre-splittings that ``cuts_at_units`` knows always cut there and look at nothing beyond, so the tokens of a text are those of its units in order. A
batch is cut into units over its bytes and dictionary-encoded in Arrow; each distinct unit goes through the library once per worker and is
remembered, many in one call.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa

#: Units, and ids of theirs, that a worker remembers at most; beyond that it begins anew.
REMEMBERED, REMEMBERED_IDS = 1_000_000, 8_000_000
#: Words that go through the library in one text.
TOGETHER = 64

#: Kinds of bytes: 0 other, 1 white space, 2 letter, 3 mark, 4 digit or bar (which special strings hold inside).
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127], _KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[[9, 10, 13, 32]], _KIND[124] = 3, 4, 2, 2, 1, 4
#: Pairs of kinds (8 * first + second) between which a unit begins; those with an unknown first are looked at again.
_CUT = np.zeros(64, dtype=bool)
_CUT[[1, 17, 25, 33, 19]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 13]] = 32
_PLAIN_WORD = re.compile(r" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: White space beyond ASCII, as UTF-8.
_ODD = np.array([int.from_bytes(chr(c).encode(), "big") for c in [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]])

#: A pre-splitting into words (fixed value).
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_at_units(settings: dict) -> bool:
    """Whether the tokens of a text are those of its units, by the settings of a tokenizers file: a byte-level BPE of known pre-splitting and
    normalisation, without special strings that would be cut or take in white space."""
    model, normalizer, split = settings["model"], settings.get("normalizer"), settings.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or model.get("dropout"):
        return False
    for t in settings.get("added_tokens", ()):
        if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or len(cut_places(np.frombuffer(t["content"].encode(), dtype=np.uint8))):
            return False
    if split.get("type") == "ByteLevel":
        return normalizer is None and split["use_regex"] and not split["add_prefix_space"]
    parts = split.get("pretokenizers", ())
    steps = [n["type"] for n in (normalizer or {}).get("normalizers", ())]
    return (
        [p["type"] for p in parts] == ["Split", "ByteLevel"]
        and (parts[0]["pattern"], parts[0]["behavior"], parts[0]["invert"]) == ({"Regex": _WORDS}, "Removed", True)
        and not parts[1]["use_regex"]
        and not parts[1]["add_prefix_space"]
        and steps == ["NFC", "Replace", "Lowercase"]
        and (normalizer["normalizers"][1]["pattern"], normalizer["normalizers"][1]["content"]) == ({"Regex": r"\s+"}, " ")
    )


def settings_of(tokenizer) -> dict:
    """A tokenizer's settings without its vocabulary."""
    settings = json.loads(tokenizer.to_str())
    settings["model"] = {k: v for k, v in settings["model"].items() if k not in ("vocab", "merges")}
    return settings


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls; offsets begin at 0 and have one more entry than the column."""
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, dtype=np.uint8) if data is None else np.frombuffer(data, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cut_places(buf: np.ndarray) -> np.ndarray:
    """Where units begin in ``buf`` (UTF-8), but for its start."""
    kind = _KIND[buf]
    latin = np.flatnonzero(buf[:-1] == 0xC3) + 1
    kind[latin[(buf[latin] != 0x97) & (buf[latin] != 0xB7)]] = 2
    at = np.flatnonzero(_CUT[(kind[:-1] << 3) | kind[1:]]) + 1
    beyond = np.flatnonzero(kind[at - 1] == 0)
    if not len(beyond):
        return at
    p = at[beyond]
    one = buf[p - 1].astype(np.int64)
    two = buf[np.maximum(p - 2, 0)].astype(np.int64) << 8 | one
    three = buf[np.maximum(p - 3, 0)].astype(np.int64) << 16 | two
    good = np.ones(len(at), dtype=bool)
    good[beyond] = (one >= 0x80) & ~(np.isin(two, _ODD) | np.isin(three, _ODD))
    return at[good]


def folded(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``buf`` with A-Z lower-cased and ASCII white space as spaces, for a tokenizer that does so itself: fewer spellings of a unit. Letters before
    characters beyond Latin-1, which could compose with them, stay, and so do texts that could hold special strings."""
    out = _FOLD[buf]
    before = np.flatnonzero(buf[1:] >= 0xC4)
    out[before] = buf[before]
    special = np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124))
    for k in np.unique(np.searchsorted(offsets, special, side="right") - 1):
        out[offsets[k] : offsets[k + 1]] = buf[offsets[k] : offsets[k + 1]]
    return out


class Units:
    """Remembers the ids that ``encode`` (a list of texts to a list of lists of ids) gives for each unit.

    ``between`` is a text of one token that stands between words where many go through the library as one text: the pre-splitting cuts on both
    sides of it, and no word of letters holds its id. ``encode_words`` may do so for texts of words of the form ``word`` alone.
    """

    def __init__(self, encode: Callable[[list[str]], list], between: str, kind: str = "<u4", encode_words: Callable[[list[str]], list] | None = None, word: re.Pattern = _PLAIN_WORD):
        self.encode, self.between, self.kind, self.encode_words, self.word = encode, between, kind, encode_words or encode, word
        (self.mark,) = encode([between])[0]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.size, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=self.kind)

    def _encoded(self, fresh: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """(units, ids of all, ids of each) of parts of ``fresh``."""
        plain = [self.word.fullmatch(v) is not None for v in fresh]
        words, other = list(compress(fresh, plain)), [v for v, x in zip(fresh, plain, strict=True) if not x]
        if words:
            texts = [self.between.join([*words[k : k + TOGETHER], ""]) for k in range(0, len(words), TOGETHER)]
            ids = np.fromiter(chain.from_iterable(self.encode_words(texts)), dtype=np.int64)
            at = np.flatnonzero(ids == self.mark)
            if len(at) != len(words):
                raise AssertionError("marks don't stand where they were put")
            yield words, np.delete(ids, at), np.diff(at, prepend=-1) - 1
        if other:
            ids = self.encode(other)
            yield other, np.fromiter(chain.from_iterable(ids), dtype=np.int64), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))

    def _places(self, values: list[str]) -> np.ndarray:
        """The units' places in the tables; new ones are learnt."""
        known = self.known
        fresh = [v for v in values if v not in known]
        if fresh and (len(known) + len(fresh) > REMEMBERED or len(self.flat) > REMEMBERED_IDS):
            self.forget()
            known, fresh = self.known, values
        for own, ids, size in self._encoded(fresh):
            known.update(zip(own, range(len(known), len(known) + len(own)), strict=True))
            self.first = np.concatenate((self.first, np.cumsum(size) - size + len(self.flat)))
            self.size = np.concatenate((self.size, size))
            self.flat = np.concatenate((self.flat, ids.astype(self.kind)))
        return np.fromiter(map(known.__getitem__, values), dtype=np.int64, count=len(values))

    def of(self, buf: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place where it begins, place in the tables) of each unit of the texts that ``begins`` (ascending, without empty texts) cuts ``buf`` into."""
        if not len(buf):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        mark = np.zeros(len(buf), dtype=bool)
        mark[cut_places(buf)] = True
        mark[begins] = True
        starts = np.flatnonzero(mark)
        cells = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(buf)).astype(np.int32)), pa.py_buffer(buf))
        coded = cells.dictionary_encode()
        return starts, self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]

    def ids(self, column: pa.Array, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; how many each text has). ``fold``: see ``folded``."""
        buf, offsets = buffer_of(column)
        buf = folded(buf, offsets) if fold else buf
        starts, unit = self.of(buf, offsets[:-1][np.diff(offsets) > 0])
        size = self.size[unit]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        flat = self.flat[np.repeat(self.first[unit] - (end - size), size) + np.arange(total)]
        before = np.concatenate(([0], end))[np.searchsorted(starts, offsets)]
        return flat, np.diff(before)
