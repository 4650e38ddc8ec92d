"""Splitting a text into units whose byte-level BPE ids do not depend on each other.

Byte-level BPE never merges across pre-tokens, and the pre-token pattern
(`` ?letters``, `` ?digits``, `` ?other``, white space) always starts a new
pre-token at a single blank that has a non-blank character on each side.  Such
blanks, which start the second unit, cut a text into units that can be encoded one by one and
remembered: ids(text) is the concatenation of ids(unit).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White-space characters other than blank and newline.
OTHER_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SINGLE_BLANK = re.compile(r"(?<=[^\s]) (?=[^\s])")


def _odd(text: str) -> bool:
    """Whether a blank of the text may stand beside white space."""
    return "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in OTHER_SPACE)


def split_units(text: str) -> list[str]:
    """Pieces of a text; its units are the first piece, and a blank and each further piece.

    ``" ".join(pieces)`` is the text.
    """
    return _SINGLE_BLANK.split(text) if _odd(text) else text.split(" ")


def distinct_pieces(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The different pieces of all texts, each piece's place among them, and where each text's pieces start and end."""
    odd = [_odd(t) for t in texts]
    plain = pc.split_pattern(pa.array([t for t, o in zip(texts, odd) if not o], pa.large_string()), " ")
    others = [_SINGLE_BLANK.split(t) for t, o in zip(texts, odd) if o]
    pieces = pa.concat_arrays([plain.flatten(), pa.array([p for x in others for p in x], pa.large_string())]).dictionary_encode()
    n = np.array([*pc.list_value_length(plain).to_pylist(), *map(len, others)], np.int64)
    ends = np.empty(len(texts), np.int64)
    ends[np.argsort(odd, kind="stable")] = np.cumsum(n)
    sizes = np.empty(len(texts), np.int64)
    sizes[np.argsort(odd, kind="stable")] = n
    return pieces.dictionary, pieces.indices.to_numpy(), ends - sizes, ends


class UnitCache(dict):
    """unit -> value, computed on a miss; emptied when full, so memory is bounded."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self._compute, self._limit = compute, limit

    def __missing__(self, unit):
        if len(self) >= self._limit:
            self.clear()
        value = self[unit] = self._compute(unit)
        return value
