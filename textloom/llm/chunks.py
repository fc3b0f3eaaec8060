"""Encode texts word by word through a bounded cache.

A byte-level pattern that lets one space join the word after it never lets a match run from a word
into the space or line break before the next word, as long as white space stands alone between
words. So a text is cut there. Each batch of texts first encodes the words that the cache lacks,
all together, and then joins its texts from the cache. Texts with other white space are encoded
whole.
"""

from __future__ import annotations

import gc
from itertools import chain

import regex

from textloom.llm.pair_merger import PairMerger

#: Entries of each of the two generations of a worker's cache: some 125 MB.
KEPT_ENTRIES = 500_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordwiseEncoder:
    """Packed ids of texts.

    merger: merges the bytes of one match of pattern. spaced: matches carry the space before them;
    otherwise white space between words leaves no trace. whole: ids of matches that need no merging.
    """

    def __init__(self, merger: PairMerger, pattern: str, spaced: bool = True, whole: dict[bytes, bytes] | None = None, entries: int = KEPT_ENTRIES):
        self.merger, self.spaced, self.whole, self.entries = merger, spaced, whole or {}, entries
        self.matches = regex.compile(pattern).findall
        #: Full, words become the former ones, from which those met again come back.
        self.words: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}

    def batch(self, texts: list[str]) -> list[bytes]:
        # A batch makes many strings and tuples but no cycles: the search for those would only cost time.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._batch(texts)
        finally:
            if collects:
                gc.enable()

    def _batch(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        if not self.spaced:
            cut = [text.replace("\n", " ").split(" ") for text in texts]
            get = self._of_words(set(chain.from_iterable(cut))).__getitem__
            return [b"".join(map(get, words)) for words in cut]
        cut = [text.replace("\n", " \n").split(" ") for text in texts]
        heads = [words.pop(0) for words in cut]
        get, head_ids = self._of_words(set(chain.from_iterable(cut))).__getitem__, self._of_strings(heads)
        for head, ids, words in zip(heads, head_ids, cut, strict=True):
            try:
                out.append(None if head[-1:].isspace() else ids + b"".join(map(get, words)))
            except TypeError:  # a word that can't be encoded apart from its neighbours has None
                out.append(None)
        if again := [k for k, ids in enumerate(out) if ids is None]:
            for k, ids in zip(again, self._of_strings([texts[k] for k in again]), strict=True):
                out[k] = ids
        return out

    def _of_words(self, needed: set[str]) -> dict[str, bytes | None]:
        """Ids of all words needed: the cache's, and those of new words, which it keeps."""
        local = dict(zip(needed, map(self.words.get, needed), strict=True))
        new = [word for word, ids in local.items() if ids is None]
        found = {word: ids for word, ids in zip(new, map(self.former.get, new), strict=True) if ids is not None}
        local.update(found)
        new = [word for word in new if word not in found]
        tailed: list[tuple[str, str, str]] = []
        plain: set[str] = set()
        other = []
        for word in new:
            if word.isalpha():
                plain.add(word)
            elif (core := word.rstrip(PUNCTUATION)).isalpha():  # letters are one match, and so is all that follows
                tailed.append((word, core, word[len(core) :]))
            else:
                other.append(word)
        cores = {core for _, core, _ in tailed}
        known = {core: ids for core in cores if (ids := self.words.get(core) or self.former.get(core)) is not None}
        letters = list(plain.union(cores).difference(known))
        space = b" " if self.spaced else b""
        made = dict(zip(letters, self._of_matches([space + word.encode() for word in letters]), strict=True))
        found.update(made)
        known.update(made)
        tails = list({tail for _, _, tail in tailed})
        tail_ids = dict(zip(tails, self._of_matches([tail.encode() for tail in tails]), strict=True))
        for word, core, tail in tailed:
            found[word] = known[core] + tail_ids[tail]
        if self.spaced:
            other = [w for w in other if w and not w[-1].isspace() and w != "\n" and not w[w[0] == "\n"].isspace()]
            found.update(zip(other, self._of_strings([w if w[0] == "\n" else " " + w for w in other]), strict=True))
        else:
            found.update(zip(other, self._of_strings(other), strict=True))
        if len(self.words) + len(found) > self.entries:
            self.words, self.former = {}, self.words
        self.words.update(found)
        local.update(found)
        return local

    def _of_strings(self, texts: list[str]) -> list[bytes]:
        cut = [self.matches(text) for text in texts]
        pieces = list(set(chain.from_iterable(cut)))
        get = dict(zip(pieces, self._of_matches([piece.encode() for piece in pieces]), strict=True)).__getitem__
        return [b"".join(map(get, found)) for found in cut]

    def _of_matches(self, pieces: list[bytes]) -> list[bytes]:
        if not self.whole:
            return self.merger.many(pieces)
        out = list(map(self.whole.get, pieces))
        missing = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(missing, self.merger.many([pieces[k] for k in missing]), strict=True):
            out[k] = ids
        return out
