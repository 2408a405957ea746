"""Token ids of whole texts with the tokenizers library, each distinct piece of text encoded once.

A text is cut before single spaces that stand between two non-space characters. Byte-level and word
pre-tokenisers never join characters across such a place (a word takes at most the one space before it, and
normalisation does not reach over a space), so the ids of a text are those of its pieces in order. Ids of the
pieces met first are kept, up to ``most``; later ones are encoded each time. A new piece that is one plain word,
with or without a full stop or comma, goes straight to the library's model; probes check this way against the
whole library when a vocabulary is loaded, and it is left out where they differ. Where the
normaliser can do no more to composed Latin letters than lower-case them, plain words do not go through it.
"""

from __future__ import annotations

import json
import os
import re
from array import array

_CUT = re.compile(r"(?<=\S)(?= \S)")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"(?=..|[^ ])( ?)([{_LETTERS}]*)([!-&(-/:-@\[-`{{-~]*)").fullmatch
_BROKEN = re.compile(rf"( ?[{_LETTERS}]+[!-&(-/:-@\[-`{{-~]*)\n([{_LETTERS}]+[!-&(-/:-@\[-`{{-~]*)").fullmatch
_PROBES = [" the", "The", "the,", " Straße.", " été", "Ñandú", " ÀÿØ,", "zx", " qqÞth.", " I", "a", " ABCé.", " |", "***", " A!!", "&&&,"]
_LINE_PROBES = [" the.\nThe", "a\nb", " été,\nÑandú", "zx!!\nqq", " I\nA.", "Straße\nÀÿØ&"]
_TIGHT = re.compile(r"[ ]?\S(?s:.*\S)?").fullmatch
_ENCODERS: dict[str, PieceEncoder] = {}


def _letter_form(normalizer: dict | None):
    """What a normaliser does to a word of ``_LETTERS``: ``str.lower``, ``str`` (nothing), or None where that is not known."""
    steps = [] if normalizer is None else normalizer["normalizers"] if normalizer["type"] == "Sequence" else [normalizer]
    for step in steps:
        gap = step["type"] == "Replace" and step["pattern"] == {"Regex": r"\s+"}
        if not gap and step["type"] not in ("NFC", "NFKC", "Lowercase"):
            return None
    return str.lower if any(step["type"] == "Lowercase" for step in steps) else str


class PieceEncoder:
    """``ids(text)`` gives little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str, most: int = 450_000, longest: int = 40):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.most, self.longest, self.known = most, longest, {}
        self.letter_form = _letter_form(json.loads(self.tokenizer.to_str())["normalizer"])
        self.plain = self._probed()
        self.lines = self._line_break() if self.plain else None
        if self.plain:  # marks after a word are the same few
            self.known.update((c, self._token("", c)) for c in map(chr, range(33, 127)) if (found := _PLAIN(c)) and found[3])

    def _probed(self) -> bool:
        cut = self.tokenizer.pre_tokenizer
        if cut is None:
            return False
        letters = [c for c in map(chr, range(256)) if _PLAIN(c)]
        mapped = {c: [x for x, _ in cut.pre_tokenize_str(c)] for c in letters}
        spaced = [x for x, _ in cut.pre_tokenize_str(" a")]
        if any(len(x) != 1 for x in mapped.values()) or len(spaced) != 1 or not spaced[0].endswith("a"):
            return False
        self.mapped, self.space = {ord(c): x[0] for c, x in mapped.items()}, spaced[0][:-1]
        self.ascii_same = all(x[0] == c for c, x in mapped.items() if c.isascii() and c != " ")
        return all(self._word(_PLAIN(x)) == whole for x, whole in zip(
            _PROBES, self._encode(_PROBES), strict=True))

    def _line_break(self) -> bytes | None:
        """Ids of a single line break between two words, or None where the words on its sides are not on their own."""
        alone, *whole = self._encode(["\n", *_LINE_PROBES])
        same = all(alone.join([self._word(_PLAIN(x)) for x in _BROKEN(p).groups()]) == w for p, w in zip(_LINE_PROBES, whole, strict=True))
        return alone if same else None

    def _encode(self, pieces: list[str]) -> list[bytes]:
        import numpy as np

        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _token(self, space: str, text: str) -> bytes:
        if not (self.ascii_same and text.isascii()):
            text = text.translate(self.mapped)
        return array("I", [x.id for x in self.model.tokenize(self.space + text if space else text)]).tobytes()

    def _word(self, found: re.Match) -> bytes:
        space, word, marks = found.groups()
        if not word:
            return self._token(space, marks)
        if self.letter_form:
            word = self.letter_form(word)
        elif self.normalizer is not None:
            word = self.normalizer.normalize_str(word)
        if not marks:
            return self._token(space, word)
        return (self.known.get(space + word) or self._token(space, word)) + (self.known.get(marks) or self._token("", marks))

    def _new(self, pieces: list[str]) -> dict[str, bytes] | None:
        """Ids of new pieces; None if one has spaces at an end, so that the text must be cut with more care."""
        fresh, other = {}, []
        for p in pieces:
            if self.plain and (found := _PLAIN(p)):
                fresh[p] = self._word(found)
            elif self.lines is not None and (found := _BROKEN(p)):
                fresh[p] = self.lines.join([self.known.get(x) or self._word(_PLAIN(x)) for x in found.groups()])
            elif _TIGHT(p):
                other.append(p)
            else:
                return None
        if other:
            fresh.update(zip(other, self._encode(other), strict=True))
        room = self.most - len(self.known)
        if room > 0:
            self.known.update([(p, x) for p, x in fresh.items() if len(p) <= self.longest][:room])
        return fresh

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        for pieces in (text.replace(" ", "\0 ").split("\0") if "\0" not in text else [""], None):
            if pieces is None:
                pieces = _CUT.split(text)
            got = list(map(self.known.get, pieces))
            if None not in got:
                return b"".join(got)
            new = {p for p, x in zip(pieces, got, strict=True) if x is None}
            fresh = self._new(new)
            if fresh is not None:
                return b"".join([fresh[p] if x is None else x for p, x in zip(pieces, got, strict=True)])
        return b"".join([self._encode([p])[0] for p in pieces])


def release() -> None:
    """Lets go of the tables of ids, so that a worker that turns to another operator has their memory again."""
    _ENCODERS.clear()


def encoder(path: str) -> PieceEncoder:
    """One encoder for each vocabulary file and Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
