"""Token ids of texts from a public byte-level vocabulary, cached by unit.

A unit is a run of non-blank characters with the blank before it. The
vocabulary's splitting pattern never crosses the start of such a blank, so the
ids of a text are the ids of its units in order, and most units were seen
before. Texts or units for which this could differ go to the library whole.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

MOST_UNITS = 400_000  # entries of the cache, which is emptied when full; results don't depend on it
UNIT = re.compile(r"\s*\S+|\s+$")
SEPARATORS = re.compile("[\x1c-\x1f]")
_ENCODERS: dict[str, "UnitEncoder"] = {}


class _Whole(Exception):
    """The text must be encoded in one piece."""


class UnitEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.fast = None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):  # the same vocabulary as a rank file
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.units: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        if self.fast is not None and max(text, default="") < "ɐ" and "<|" not in text:
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        if SEPARATORS.search(unit):
            raise _Whole
        return self._ids(unit)

    def _spaced(self, text: str) -> bytes:
        """Units parted by single blanks; anything else raises."""
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            raise _Whole
        words = self.words
        try:
            return b"".join([self._unit(first), *map(words.__getitem__, rest)])
        except KeyError:
            if len(words) > MOST_UNITS:
                words.clear()
            for word in rest:
                if word not in words:
                    if not word or word[-1].isspace():
                        raise _Whole from None
                    words[word] = self._unit(" " + word)
            return b"".join([self._unit(first), *map(words.__getitem__, rest)])

    def _parsed(self, text: str) -> bytes:
        units = self.units
        if len(units) > MOST_UNITS:
            units.clear()
        found = UNIT.findall(text)
        for unit in found:
            if unit not in units:
                units[unit] = self._unit(unit)
        return b"".join(map(units.__getitem__, found))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        for way in (self._spaced, self._parsed):
            try:
                return way(text)
            except _Whole:
                continue
        return self._ids(text)


def encoder(path: str) -> UnitEncoder:
    """The encoder of this process for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]
