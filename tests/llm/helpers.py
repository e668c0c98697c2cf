"""Texts for the tests of this folder."""

import random
import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def shingles(text):
    w = [fold(x) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randint(1, 8))) for _ in range(n))


def corpus(seed=1, groups=12, size=90):
    """Texts with exact copies, near copies in chains, and odd ones."""
    rng = random.Random(seed)
    texts = [None, "", " \t\n ", "one", "One", "a b c", "a b c d e", "A  b\tc d\x0be"]
    for _ in range(groups):
        base = prose(rng, rng.randint(30, size)).split(" ")
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            base = list(base)
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = prose(rng, 1)
            texts.append(" ".join(base))
    rng.shuffle(texts)
    return texts
