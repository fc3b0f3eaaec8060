"""Ids of the public tokenizers' JSON vocabularies.

The tokenizers library spends most of its time on bookkeeping that ids don't need. Here tiktoken's
merger, which has no cache and so needs the same memory for any text, gets the vocabulary's merges as
ranks: each merge makes a string that no other makes, so to merge the pair of least rank is the same
in both. In a vocabulary whose words end in a suffix, each word ends in a zero byte instead, which
the merges of least rank join to the byte before it. Texts that can't be shown to be treated as the
library does go to the library as it is. Tests hold both equal.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from textloom.llm.common import kept

#: Longer runs of white space go to the library: the pattern's look-ahead keeps a place on a stack for each character.
LONGEST_BLANK = 10_000
_BLANK = re.compile(rf"\s{{{LONGEST_BLANK}}}").search
#: The lower-casing normalizer treats these one by one, and the white space among them only parts words.
_PLAIN = re.compile(r"[\x20-\x7e\n\xa1-\xff]*").fullmatch
# The vocabulary's pattern for words, over lower-case characters up to U+00FF.
_LETTERS, _NUMBERS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+").findall


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(free)) for b in range(256)]


#: Kinds of characters up to U+00FF: 0 white space, then letters, numbers and others.
_KINDS = np.array([0 if c.isspace() else 1 if re.match(f"[{_LETTERS}]", c) else 2 if re.match(f"[{_NUMBERS}]", c) else 3 for c in map(chr, range(256))], np.uint8)


def _ended(text: str) -> str:
    """The words of a text without apostrophes, each with a zero byte behind it, then the byte 1 with one."""
    letters = np.frombuffer((text + "\1").encode("latin-1"), np.uint8)
    kinds = _KINDS.take(letters)
    parts = np.zeros((len(letters), 2), np.uint8)
    parts[:, 0] = letters
    keep = np.ones((len(letters), 2), bool)
    keep[:, 0] = kinds != 0
    keep[:-1, 1] = (kinds[1:] != kinds[:-1]) | (kinds[:-1] == 2)
    keep[-2:, 1] = True
    keep[:, 1] &= keep[:, 0]
    return parts[keep].tobytes().decode("latin-1")


class VocabularyIds:
    """Ids of texts, packed as little-endian unsigned 16-bit integers.

    added: the strings of the vocabulary's added tokens get those tokens' ids, as in the library as
    it is loaded; otherwise they are ordinary text.
    """

    def __init__(self, path: str, added: bool = False):
        with open(path, "rb") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added
        #: Texts that hold one of these go to the library.
        self.added = [token["content"] for token in spec["added_tokens"]] if added else []
        vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        #: With a normalizer the vocabulary is lower-cased, word-final and blind to white space.
        self.lower = spec["normalizer"] is not None
        letters = byte_letters()
        of_letter = {letter: bytes([b]) for b, letter in enumerate(letters)}
        ranks, ids = {bytes([b]): b for b in range(256)}, [vocabulary[letter] for letter in letters]

        def add(token: str) -> None:
            final = bool(suffix) and token.endswith(suffix)
            data = b"".join(of_letter[c] for c in (token[: -len(suffix)] if final else token)) + b"\0" * final
            if ranks.setdefault(data, len(ids)) == len(ids):
                ids.append(vocabulary[token])

        if suffix:
            for letter in letters:
                add(letter + suffix)
        for pair in spec["model"]["merges"]:
            add("".join(pair.split(" ") if isinstance(pair, str) else pair))
        self.ids = np.array(ids, "<u2")
        #: The id of the byte 1 alone, which no plain text holds.
        self.parting = vocabulary[letters[1] + suffix]
        pattern = r"[^\x00]+\x00" if self.lower else public_tokenizers.PATTERN
        self.merge = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def batch(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        if self.lower:
            plain = [k for k, text in enumerate(texts) if _PLAIN(text) and not self._has_added(text)]
            for k, ids in zip(plain, self._joined([texts[k].lower() for k in plain]), strict=True):
                out[k] = ids
        else:
            for k, text in enumerate(texts):
                if not self._has_added(text) and not (len(text) >= LONGEST_BLANK and _BLANK(text)):
                    out[k] = self.ids[self.merge(text)].tobytes()
        return [self._of_library(text) if ids is None else ids for text, ids in zip(texts, out, strict=True)]

    def _has_added(self, text: str) -> bool:
        return any(token in text for token in self.added)

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Ids of plain lower-case texts, merged as one string in which the byte 1 parts them."""
        if not texts:
            return []
        words = "".join("\0".join([*_WORDS(text), "\1\0"]) if "'" in text else _ended(text) for text in texts)
        found = self.merge(words)
        ids = self.ids.take(np.frombuffer(array("i", found), np.int32))
        ends = (np.flatnonzero(ids == self.parting) * 2).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *(end + 2 for end in ends)], ends)]

    def _of_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def loaded(path: str, added: bool = False) -> VocabularyIds:
    """One encoder for each worker process."""
    return kept((path, added), lambda: VocabularyIds(path, added))
