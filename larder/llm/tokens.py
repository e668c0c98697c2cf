"""Token ids of whole texts, word by word from a table of words already encoded."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; must be set before the import

from tokenizers import Tokenizer  # noqa: E402

#: Words in the table before it is emptied, characters of the texts that are looked up together, and new words encoded together.
KNOWN = 1_000_000
TOGETHER = 1 << 20
LEARNT = 100
# Texts of these characters alone are unchanged by NFC, and both engines agree on their letters, lower case and blanks.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\xa1-\u012f\u0131-\u024f]*")
_loaded: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Encodes texts as `Tokenizer.encode(text, add_special_tokens=False)` does.

    The tokenizer of the file parts lower-cased text at blanks and encodes what stands between them alone, so
    a text's ids are those of its words, one after another. Words are looked up in a table; new ones go through the
    tokenizer together, less its normalizer, which leaves lower-cased words of the plain range as they are. A text with characters outside the plain range, or that spells a special token, is given to
    the tokenizer as a whole, as is every text if the file has another scheme. A Python worker keeps the
    table for its next tasks (`load`).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            scheme = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in scheme["added_tokens"]]
        self.pattern = None
        steps = [s.get("type") for s in (scheme.get("normalizer") or {}).get("normalizers", [])]
        split = (scheme.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        if steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("invert") and split.get("behavior") == "Removed":
            self.pattern = regex.compile(split["pattern"]["Regex"])
            self.words = Tokenizer.from_file(path)
            self.words.normalizer = None
        self._forget()

    @classmethod
    def load(cls, path: str) -> WordTokenizer:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, new: list[str]) -> None:
        for first in range(0, len(new), LEARNT):
            part = new[first : first + LEARNT]
            encoding = self.words.encode(" ".join(part), add_special_tokens=False)
            ids, pieces = np.array(encoding.ids, np.uint32), np.array(encoding.word_ids, np.int64)
            # How many pieces each word has, where its last piece ends among the ids.
            upto = np.cumsum([1 if w.isalpha() else len(self.pattern.findall(w)) for w in part])
            ends = np.searchsorted(pieces, upto)
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            count = len(self.number)
            while count + len(part) + 1 > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.ids[self.used : self.used + len(ids)] = ids
            self.starts[count + 1 : count + 1 + len(part)] = self.used + ends
            self.used += len(ids)
            self.number.update(zip(part, range(count, count + len(part))))

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        first = 0
        while first < len(texts):
            end, size = first, 0
            while end < len(texts) and (end == first or size + len(texts[end]) <= TOGETHER):
                size += len(texts[end])
                end += 1
            yield from self._encode(texts[first:end])
            first = end

    def _encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        lower = [t.lower() for t in texts]
        plain = [self.pattern is not None and bool(_PLAIN.fullmatch(t)) and not any(s in t or s in low for s in self.special)
                 for t, low in zip(texts, lower, strict=True)]
        words = [low.split() if p else [] for low, p in zip(lower, plain, strict=True)]
        every = list(chain.from_iterable(words))
        index = np.fromiter(map(self.number.get, every, repeat(-1)), np.int64, len(every))
        unknown = np.flatnonzero(index < 0)
        if len(unknown):
            new = {every[i] for i in unknown.tolist()}
            if len(self.number) + len(new) > KNOWN:
                self._forget()
                new, unknown = set(every), np.arange(len(every))
            self._learn(sorted(new))
            index[unknown] = np.fromiter(map(self.number.__getitem__, map(every.__getitem__, unknown.tolist())), np.int64, len(unknown))
        begin = self.starts[index]
        sizes = self.starts[index + 1] - begin
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], sizes)]
        at = 0
        for text, own, p in zip(texts, words, plain, strict=True):
            if p:
                yield ids[upto[at] : upto[at + len(own)]]
                at += len(own)
            else:
                yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
