"""Words of a text as near-same comparison sees them.

One translation per text folds look-alikes, accents and case and turns all else than letters and digits into spaces.
Words are what remains between spaces; of a piece that holds Han characters, the pairs of adjacent characters count.
"""

from __future__ import annotations

import unicodedata as ud

import numpy as np
import xxhash

from veridelta.llm.lookalike import _hidden, fold_cluster


def is_han(ch: str) -> bool:
    o = ord(ch)
    return 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF or 0x20000 <= o <= 0x323AF or o == 0x3007


def one_case(ch: str) -> str:
    """Small letters in which look-alikes of either case are one: a letter is folded by what its capital looks like."""
    return fold_cluster(fold_cluster(ch).upper()).lower()


class _Plain(dict):
    """Code point -> its folded, lower-case, accentless letters or digits; a space for the rest, nothing for the invisible."""

    def __missing__(self, o: int) -> str:
        ch = chr(o)
        if _hidden(o) or ud.combining(ch):
            to = ""
        elif is_han(ch):
            to = ch
        else:
            low = one_case(ch)
            to = "".join(x for x in ud.normalize("NFKD", low) if not ud.combining(x))
            to = "".join(x if x.isalnum() else " " for x in to) or " "
        self[o] = to
        return to


PLAIN = _Plain()


def plain(text: str) -> str:
    return text.translate(PLAIN)


class _Pieces(dict):
    """Piece -> the strings it counts as."""

    def __missing__(self, piece: str) -> tuple[str, ...]:
        if len(self) > 400_000:
            self.clear()
        out = tuple(piece[i : i + 2] for i in range(len(piece) - 1)) or (piece,) if not piece.isascii() and any(map(is_han, piece)) else (piece,)
        self[piece] = out
        return out


class _Hashes(dict):
    """String -> signed 64-bit hash, bounded."""

    def __missing__(self, s: str) -> int:
        if len(self) > 1_500_000:
            self.clear()
        out = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
        self[s] = out
        return out


_pieces, _hashes = _Pieces(), _Hashes()


def words(text: str) -> list[str]:
    """The words (and pairs of Han characters) in order."""
    p = plain(text)
    if p.isascii():
        return p.split()
    return [w for piece in p.split() for w in _pieces[piece]]


def word_hashes(text: str) -> np.ndarray:
    """Sorted distinct hashes of the words."""
    got = words(text)
    return np.unique(np.fromiter(map(_hashes.__getitem__, got), np.uint64, len(got)))


def jaccard(a: str, b: str) -> float:
    """Brute force, for tests."""
    x, y = set(words(a)), set(words(b))
    return len(x & y) / len(x | y) if x or y else 0.0
