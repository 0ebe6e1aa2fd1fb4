"""A unigram piece vocabulary: matches by Aho-Corasick, units, tie rules.

The pieces and scores of a sentencepiece model file are read as a unigram
vocabulary.  Text is spelled with U+2581 for the space and a leading one, as
the model does it.  No piece holds U+2581 behind another character (checked
when the file is read), so every best or sampled segmentation breaks before a
U+2581 that follows another character: the text falls into *units* (a run of
U+2581 and the characters up to the next one) whose lattices are independent.
A unit is cut once more between a letter and punctuation that no piece holds
right behind a letter.

Scores of the file are integers, so sums over units are exact.  A character
that no single-character piece covers takes an edge of its own, ``UNKNOWN``
below the least score, and is spelled by the byte pieces of its UTF-8 form.  A
literal U+2581 in a text is such a character, which keeps decoding lossless.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import sentencepiece

SPACE = "\u2581"
#: The unit of a literal U+2581 of the text.  No other unit looks like it.
LITERAL = "\x00\u2581"
UNKNOWN = 10.0
PUNCTUATION = "\n.,;:!?|#$%&*()"


@dataclass(frozen=True)
class Vocabulary:
    matcher: ahocorasick.Automaton  # piece -> (id, score)
    unknown: float
    byte_ids: tuple[int, ...]
    spell: tuple[bytes, ...]  # what each piece decodes to, with a space for U+2581
    singles: frozenset[str]  # characters that are pieces
    breaks: str  # punctuation that no piece holds right behind a letter

    def edges(self, unit: str) -> list[list[tuple[int, float, int]]]:
        """For each end position, the (start, score, piece) of its edges by start; piece -1: bytes."""
        if unit == LITERAL:
            return [[], [], [(0, self.unknown, -1)]]
        out: list[list[tuple[int, float, int]]] = [[] for _ in range(len(unit) + 1)]
        single = [False] * len(unit)
        for last, (piece, score, size) in self.matcher.iter(unit):
            out[last + 1].append((last + 1 - size, score, piece))
            if size == 1:
                single[last] = True
        for i, known in enumerate(single):
            if not known:
                out[i + 1].append((i, self.unknown, -1))
        for ends in out:
            ends.sort()
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read a model file; kept for the life of the process."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    matcher = ahocorasick.Automaton()
    byte_ids = [-1] * 256
    spell = [b""] * size
    least = 0.0
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            spell[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            if SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {i} has U+2581 behind another character")
            score = model.get_score(i)
            least = min(least, score)
            matcher.add_word(piece, (i, score, len(piece)))
            spell[i] = piece.replace(SPACE, " ").encode()
    if -1 in byte_ids:
        raise ValueError("the model has no byte pieces")
    matcher.make_automaton()
    behind = {b for piece in matcher for a, b in zip(piece, piece[1:]) if a.isalpha()}
    breaks = "".join(c for c in PUNCTUATION if c not in behind)
    singles = frozenset(piece for piece in matcher if len(piece) == 1)
    return Vocabulary(matcher, least - UNKNOWN, tuple(byte_ids), tuple(spell), singles, breaks)


def best(vocab: Vocabulary, unit: str) -> tuple[float, int]:
    """Score and piece count of the best segmentation.

    The tie rule of the tokenizers: edges are tried by start in ascending
    order and replace the one before only with a strictly higher score, so
    of equal scores the longest last piece stays.  The automaton yields the
    matches of an end from the longest, so where every character is a piece
    they need no sorting.
    """
    if vocab.singles.issuperset(unit):
        top = [0.0] + [-math.inf] * len(unit)
        n = [0] * (len(unit) + 1)
        for last, (_, value, size) in vocab.matcher.iter(unit):
            start = last + 1 - size
            total = top[start] + value
            if total > top[last + 1]:
                top[last + 1], n[last + 1] = total, n[start] + 1
        return top[-1], n[-1]
    score, count = [0.0] * (len(unit) + 1), [0] * (len(unit) + 1)
    for end, edges in enumerate(vocab.edges(unit)):
        top = None
        for start, value, piece in edges:
            total = score[start] + value
            if top is None or total > top:
                top, n = total, count[start] + (1 if piece >= 0 else len(unknown_bytes(unit, start)))
        if top is not None:
            score[end], count[end] = top, n
    return score[-1], count[-1]


class UnitCache:
    """What a unit gives, kept for up to ``most`` units and then begun anew."""

    def __init__(self, make, most: int = 400_000):
        self.make, self.most, self.known = make, most, {}

    def __call__(self, units: list[str]) -> list:
        if len(self.known) > self.most:
            self.known.clear()
        known, make = self.known, self.make
        out = []
        for unit in units:
            got = known.get(unit)
            if got is None:
                got = make(unit)
                if len(unit) < 64:
                    known[unit] = got
            out.append(got)
        return out


def unknown_bytes(unit: str, start: int) -> bytes:
    """The bytes of the unknown character at ``start``."""
    return (SPACE if unit == LITERAL else unit[start]).encode()


def _units_by_hand(texts: list[str], vocab: Vocabulary) -> list[list[str]]:
    """The units of texts that may hold NUL or U+2581, with the breaks that all texts have."""
    import pyarrow as pa
    import pyarrow.compute as pc

    out: list[list[str]] = []
    for text in texts:
        units: list[str] = []
        for i, part in enumerate(text.split(SPACE)):
            spelled = SPACE * (i == 0 and text != "") + part.replace(" ", SPACE)
            units += [LITERAL] * (i > 0) + re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", spelled)
        if vocab.breaks:  # NUL is spelled out meanwhile, by characters that make no break
            spelled = [u.replace("\x01", "\x01\x02").replace("\x00", "\x01\x03") for u in units]
            broken = pc.replace_substring_regex(pa.array(spelled, pa.large_string()), _break_before(vocab), "\\1\x00\\2")
            units = [u.replace("\x01\x03", "\x00").replace("\x01\x02", "\x01") for b in broken.to_pylist() for u in b.split("\x00")]
        out.append(units)
    return out


def _break_before(vocab: Vocabulary) -> str:
    return rf"(\pL)([{re.escape(vocab.breaks)}])"


def units_of(text, vocab: Vocabulary):
    """Codes, distinct units and row offsets of texts.

    A text is split at single spaces; runs of spaces stay with the unit after
    them, which is found by regular expression only where there are any.  The
    first part of a text has its leading U+2581 too, so all units begin with one.
    An empty text has no unit.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    from . import _words as W

    spelled = pc.replace_substring(text, " ", SPACE)
    spelled = pc.binary_join_element_wise(pa.scalar(SPACE, text.type), spelled, pa.scalar("", text.type))
    spelled = pc.if_else(pc.equal(pc.binary_length(text), 0), pa.scalar("", text.type), spelled)
    # a break before each U+2581 that follows another character
    broken = pc.replace_substring_regex(spelled, f"([^{SPACE}]){SPACE}", "\\1\x00" + SPACE)
    if vocab.breaks:
        broken = pc.replace_substring_regex(broken, _break_before(vocab), "\\1\x00\\2")
    units = pc.split_pattern(broken, "\x00")
    odd = pc.match_substring_regex(text, f"[\x00{SPACE}]").to_numpy(zero_copy_only=False).astype(bool)
    if odd.any():  # these texts have one of the marks themselves: cut by hand
        by_hand = pa.array(_units_by_hand(text.filter(pa.array(odd)).to_pylist(), vocab), units.type)
        place = np.empty(len(odd), np.int64)
        place[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(odd))
        units = pa.concat_arrays([units.filter(pa.array(~odd)), by_hand]).take(pa.array(place))
    flat, offsets = W.flat_parts(units, drop_empty=True)
    return *W.coded(flat), offsets
