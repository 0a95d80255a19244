"""Cuts texts into units whose encodings can be remembered.

Byte-level tokenizers first split a text by public_tokenizers.PATTERN. A single space between two other characters
always begins a match there, so each word with its leading space is encoded by itself and the results are joined. Where
white space follows a space the rule does not hold, and the whole text is encoded at once instead. So it is with one or two line
ends between other characters, each a match of its own: a line end goes with the word after it. The pattern also cuts between a
run of letters and punctuation after it, so an unknown word with such a tail is encoded from the two.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from itertools import filterfalse, islice

#: Units that a worker remembers at most, those it met first; it starts anew where most units of a batch are unknown.
#: Longer units than LONG characters are not remembered.
REMEMBERED, LONG = 300_000, 48

#: Punctuation after a word, letters only and those of before U+0250, is encoded by itself if it has MOST_TAIL characters at most.
TAIL, MOST_TAIL, LETTERS_END = ".,;:!?%$#&*", 4, "\u0250"

#: White space other than spaces and line ends: where it stands, neither rule holds. ASCII first.
OTHER_SPACE = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]
ASCII_SPACE = [c for c in OTHER_SPACE if c.isascii()]


def unsafe(text: str) -> bool:
    """Whether a rule does not hold: a space before white space or the end, three line ends or two at the end, a line end before a space, other white space."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or text.endswith((" ", "\n\n")):
        return True
    return any(c in text for c in (ASCII_SPACE if text.isascii() else OTHER_SPACE))


class _Known(dict):
    """Remembered units and, for one batch, `passing`: the others."""

    passing: dict[str, bytes]

    def __missing__(self, unit: str) -> bytes:
        return self.passing[unit]


class UnitCache:
    """encode: units -> their encodings, each as bytes. whole: tells the texts that must not be cut, besides those for which the rule does not hold."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], remembered: int = REMEMBERED, whole: Callable[[str], object] | None = None):
        self.encode_units = encode
        self.whole = whole
        self.remembered = remembered
        self.first, self.later = _Known(), _Known()
        self.tails: dict[str, bytes] = {}

    def _encode(self, known: _Known, units: list[str], lead: str) -> dict[str, bytes]:
        """The units' encodings with `lead` before each that does not begin with a line end; words and their tails are looked up or encoded apart."""
        cut = {w: b for w in units if 0 < len(w) - len(b := w.rstrip(TAIL)) <= MOST_TAIL and b.isalpha() and (b.isascii() or max(b) < LETTERS_END)}
        tails = {w[len(b) :] for w, b in cut.items()} - self.tails.keys()
        self.tails.update(zip(tails, self.encode_units(list(tails))))
        plain = list({w for w in units if w not in cut}.union(filterfalse(known.__contains__, cut.values())))
        got = dict(zip(plain, self.encode_units([w if w.startswith("\n") else lead + w for w in plain])))
        for w, b in cut.items():
            got[w] = (got[b] if b in got else known[b]) + self.tails[w[len(b) :]]
        return got

    def _learn(self, known: _Known, words: set[str], lead: str) -> None:
        """Afterwards known has all these words, for this batch at least."""
        known.passing = {}
        new = list(filterfalse(known.__contains__, words))
        if len(known) + len(new) > self.remembered and 2 * len(new) > len(words):
            known.clear()
            new = list(words)
        if new:
            known.passing = self._encode(known, new, lead)
            room = max(0, self.remembered - len(known))
            known.update(islice(((w, x) for w, x in known.passing.items() if len(w) <= LONG), room))

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if unsafe(t) or (self.whole and self.whole(t))]
        split = [t.replace("\n", " \n").split(" ") for t in texts]
        for i in whole:
            split[i] = [""]
        first = [w.pop(0) for w in split]
        self._learn(self.first, set(first), "")
        self._learn(self.later, set().union(*split), " ")
        of_later = self.later.__getitem__
        out = [self.first[a] + b"".join(map(of_later, w)) for a, w in zip(first, split)]
        for i, x in zip(whole, self.encode_units([texts[i] for i in whole]) if whole else []):
            out[i] = x
        return out
