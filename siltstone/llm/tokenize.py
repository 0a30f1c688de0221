"""Token ids of whole texts by a public tokenizer file, word by word with bounded caches.

Neither the normaliser nor the pre-tokenizer of the word-level tokenizer joins characters
across white space, so the ids of a text are the ids of its ASCII-space separated words in
order.  A text of printable ASCII, ASCII white space and precomposed Latin-1 letters is cut
by the tokenizer's own pattern; a part that was met before costs one dictionary lookup and
only new parts go to the merge model.  The words of any other text are cached one by one and
new ones go through the whole tokenizer.  ``probe`` tests both shortcuts on the tokenizer at
hand; where one does not hold it is not taken.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Words in each of the two generations of the word cache, and parts in those of the part cache.
_CACHE = 200_000
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")
_PROBES = [
    "a b", "Ab\ncd  Ef", "x's\tit'S 12 3 don't WE'LL !!'s a1b2", "  é É é ñ ß Ü×÷ÿ", "Σ ΑΣ Σ", "a b  c",
    "!! a*** |b ### $5,000.00 (x) <y>", "<|endoftext|> x<|endoftext|>y", "Éauouon. für straße... niño, l'été",
]


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ..."""
    printable = [*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in printable}
    return table | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in table)}


class _Cache:
    """Two generations: what is asked for again survives, the rest is dropped when the young one is full."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def turn(self) -> None:
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young


class WordTokenizer:
    """Ids of texts; one per Python worker."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.words, self.parts = _Cache(_CACHE), _Cache(_CACHE)
        self.by_word = self.by_part = True
        self.probe()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def probe(self) -> None:
        self.by_part = all(list(self._by_parts(p)) == self.whole(p) for p in _PROBES if self._plain(p)) if hasattr(self.model, "tokenize") else False
        self.by_word = all([i for w in p.encode().split() for i in self.whole(w.decode())] == self.whole(p) for p in _PROBES)
        self.words, self.parts = _Cache(_CACHE), _Cache(_CACHE)

    @staticmethod
    def _plain(text: str) -> bool:
        return "<|" not in text and _PLAIN.fullmatch(text) is not None

    def _by_parts(self, text: str) -> np.ndarray:
        parts = _PARTS.findall(text.lower())
        young, old = self.parts.young, self.parts.old
        for part in set(parts).difference(young):
            got = old.get(part)
            if got is None:
                spelt = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
                got = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
            young[part] = got
        ids = np.frombuffer(b"".join(map(young.__getitem__, parts)), dtype="<u4")
        self.parts.turn()
        return ids

    def _by_words(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").split()
        young, old = self.words.young, self.words.old
        for w in set(words).difference(young):
            got = old.get(w)
            young[w] = array("I", self.whole(w.decode("utf-8", "surrogatepass"))).tobytes() if got is None else got
        ids = np.frombuffer(b"".join(map(young.__getitem__, words)), dtype="<u4")
        self.words.turn()
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids (uint32) of a whole text; null is empty."""
        if not text:
            return np.zeros(0, dtype="<u4")
        if self.by_part and self._plain(text):
            return self._by_parts(text)
        return self._by_words(text) if self.by_word else np.array(self.whole(text), dtype="<u4")
