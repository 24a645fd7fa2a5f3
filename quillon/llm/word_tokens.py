"""Whole-text tokenisation with a vocabulary whose tokens never cross white space, by remembered words."""

from __future__ import annotations

import os
import re
from array import array
from itertools import compress, filterfalse
from operator import concat

import numpy as np

WORD_BPE = "word_bpe_49k.json"

#: Characters that Python counts as white space and the tokenizer does not.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"
#: Marks that may follow a word's letters: ASCII punctuation other than ' and _ (which bind to letters).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"
#: A word, of words parted by spaces, that has more than lower-case Latin letters which normalisation leaves alone.
_OTHER = re.compile(r"[^ ]*[^a-zß-öø-ÿ ][^ ]*")
#: Words that a worker remembers; it forgets all of them when there are more.
REMEMBERED = 2_000_000


def resolve(path: str) -> str:
    """A tokenizer file's place: a path as it is, a bare name by the installed package of vocabularies."""
    if os.sep in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


class WordTokenizer:
    """ids of whole texts as little-endian unsigned 32-bit integers.

    The tokenizer cuts a text at white space before anything else, so a text's ids are its words' ids in
    a row. A text with characters on whose being white space Python and the tokenizer differ goes to the
    tokenizer as a whole.
    """

    def __init__(self, path: str = WORD_BPE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(resolve(path))
        # for words of plain letters: the same model without the steps that such words do not need
        self.plain = Tokenizer.from_file(resolve(path))
        self.plain.normalizer = None
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        for own in (self.tokenizer, self.plain):
            if hasattr(own.model, "_resize_cache"):
                own.model._resize_cache(0)  # words are remembered here
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        """Each word's ids, from one call: a token that ends a word says so."""
        if not words:
            return []
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _learn(self, missing: set[str]) -> None:
        words = self.words
        # words of lower-case letters alone need no more than their ids
        odd = set(_OTHER.findall(" ".join(missing)))
        simple, todo = list(missing - odd), list(odd)
        words.update(zip(simple, self._encode_plain(simple), strict=True))
        letters = [w.rstrip(_MARKS) for w in todo]
        cores = list(map(str.lower, letters))
        if odd := set(_OTHER.findall(" ".join(cores))):
            good = [c not in odd for c in cores]
            other = [w for w, g in zip(todo, good, strict=True) if not g]
            words.update(zip(other, self._encode(other), strict=True))
            todo, letters, cores = (list(compress(xs, good)) for xs in (todo, letters, cores))
        tails = [w[len(l) :] for w, l in zip(todo, letters, strict=True)]
        words[""] = b""
        marks = list(set(tails) - words.keys())
        words.update(zip(marks, self._encode(marks), strict=True))
        need = list(set(cores) - words.keys())
        words.update(zip(need, self._encode_plain(need), strict=True))
        get = words.__getitem__
        words.update(zip(todo, map(concat, map(get, cores), map(get, tails)), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        texts = [t or "" for t in texts]
        pieces = [None if any(c in t for c in _ODD_SPACE) else t.split() for t in texts]
        known = self.words
        missing: set[str] = set()
        for p in pieces:
            missing.update(filterfalse(known.__contains__, p or ()))
        if missing:
            if len(known) + 2 * len(missing) > REMEMBERED:
                known.clear()
                missing.update(*[p for p in pieces if p])
            self._learn(missing)
        whole = iter(self._encode([t for t, p in zip(texts, pieces, strict=True) if p is None]))
        return [next(whole) if p is None else b"".join(map(known.__getitem__, p)) for p in pieces]


_OPEN: dict[str, WordTokenizer] = {}


def tokenizer(path: str = WORD_BPE) -> WordTokenizer:
    """This process's tokenizer for path."""
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]
