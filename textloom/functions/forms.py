"""Forms annotated once per worker: the rules of ``annotate`` for one string, and token arrays as numbers.

``annotate`` works on columns; where millions of tokens of a file are read in order, an Arrow function looks each
distinct form up here instead. Words are still cut by ``annotate.words`` on the JVM, so the two never disagree on them.
"""

from __future__ import annotations

import re
import unicodedata
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from textloom.functions import lexicon as L

TAGS = ("VERB", "NOUN", "PRON", "PREP", "DET", "ADV")
VERB, NOUN = 0, 1
#: Annotated forms that a worker keeps; beyond it starts anew.
KEPT = 500_000
_PARTS = re.compile(r"[A-Z][a-z]+|[a-z]+|[A-Z]+(?![a-z])")
_STOP = frozenset(L.STOP_WORDS)
_BY_WORD = [(frozenset(words), code) for words, code in ((L.PRONOUNS, 2), (L.PREPOSITIONS, 3), (L.DETERMINERS, 4), (L.ADVERBS, 5))]


def hash64(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; ``llm`` has its own, as either may go without the other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lemma(text: str) -> str:
    parts = [x for x in text.split("_") if x] if "_" in text and text[0] != "_" else _PARTS.findall(text)
    if not parts:
        return text.lower()
    word = parts[-1].lower()
    for suffix in L.LEMMA_SUFFIXES:
        if word.endswith(suffix) and len(word) > len(suffix) + L.LEMMA_LEAST:
            return word[: -len(suffix)]
    return word


def _has(text: str, category: str) -> bool:
    return any(unicodedata.category(c) == category for c in text)


def tag(text: str) -> int:
    """A place in ``TAGS``."""
    if text.startswith(L.VERB_PREFIXES):
        return VERB
    if unicodedata.category(text[0]) == "Lu" and _has(text, "Ll"):
        return NOUN
    if text.endswith(L.CALLBACK_SUFFIXES):
        return VERB
    low = text.lower()
    for words, code in _BY_WORD:
        if low in words:
            return code
    return VERB if low.endswith(L.VERB_SUFFIXES) else NOUN


def _style(text: str) -> int:
    """Bits: 1 snake, 2 an upper-case letter behind the first character, 4 one at the start."""
    if text.isascii() and text.islower():
        return int("_" in text and text[0] != "_")
    return ("_" in text and text[0] != "_") + 2 * _has(text[1:], "Lu") + 4 * (unicodedata.category(text[0]) == "Lu")


class Annotator:
    """Numbers of lemmas, tags, stop flags, styles and lengths of forms; lemma numbers hold until ``clear``."""

    stop_words = _STOP

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.lemmas: dict[str, int] = {}
        self._known: dict[str, tuple[int, int, bool, int, int, int]] = {}

    def full(self) -> bool:
        return len(self._known) > KEPT

    def forms(self) -> list[str]:
        """By lasting number, until ``clear``."""
        return list(self._known)

    def _new(self, form: str) -> tuple[int, int, bool, int, int, int]:
        found = lemma(form)
        out = self._known[form] = (self.lemmas.setdefault(found, len(self.lemmas)), tag(form), found.lower() in _STOP, _style(form), len(form), len(self._known))
        return out

    def tokens(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """(row of each token, its form's number, the forms, table): table has lemma, tag, stop, style, length and lasting number of each form."""
        sizes = np.diff(words.offsets.to_numpy()) if not words.null_count else words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        known, new = self._known.get, self._new
        table = np.array([known(f) or new(f) for f in coded.dictionary.to_pylist()], np.int64).reshape(-1, 6)
        return np.repeat(np.arange(len(words)), sizes), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, table
