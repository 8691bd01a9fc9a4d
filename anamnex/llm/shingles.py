"""Word shingles as 64-bit hashes, and MinHash signatures of them.

Words are what stands between white space, in lower case. A shingle is five words in a row; a text of fewer words has
one shingle of all of them, a text without words none. Hashes of words come from running polynomial sums over the bytes
of many texts at once, so that no word becomes an object.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

WORDS = 5
OTHER_SPACE = re.compile("[\x85\xa0  -     　]")
#: The bytes of str.isspace() in ASCII.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
BASE = 0x9E3779B97F4A7C15
STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


#: Characters of a text whose words are hashed at once; longer texts go in parts that end at white space.
PART = 1 << 20
ANY_SPACE = re.compile(r"\s")


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's begin."""
    plain = [OTHER_SPACE.sub(" ", t) if not t.isascii() else t for t in (t.lower() for t in texts)]
    parts = [t.encode("utf-8", "surrogatepass") for t in plain]
    raw = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    ends_of_text = np.cumsum(np.array([len(p) + 1 for p in parts], np.int64))
    space = SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = powers(1 << max(20, int(len(raw)).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    word = mixed((total[ends] - total[starts]) * down[starts])
    return word, np.searchsorted(starts, np.concatenate([[0], ends_of_text]) + 1)


def long_text_words(text: str) -> np.ndarray:
    out, start = [], 0
    while start < len(text):
        space = ANY_SPACE.search(text, start + PART) if start + PART < len(text) else None
        end = space.start() if space else len(text)
        out.append(hashed_words([text[start:end]])[0])
        start = end
    return np.concatenate(out)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted, distinct shingles of each text."""
    if any(len(t) > PART for t in texts):
        out = []
        for t in texts:
            word, first = (w := long_text_words(t), np.array([0, len(w)])) if len(t) > PART else hashed_words([t])
            out += sets_of(word, first.tolist())
        return out
    word, first = hashed_words(texts)
    return sets_of(word, first.tolist())


def sets_of(word: np.ndarray, first: list[int]) -> list[np.ndarray]:
    many = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        many = many * STEP + word[k : k + len(many)]
    many = mixed(many)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= WORDS:
            got = np.sort(many[a : b - WORDS + 1])
            if len(got) > 1:
                got = got[np.concatenate([[True], got[1:] != got[:-1]])]
        elif b > a:
            h = np.zeros(1, np.uint64)
            for k in range(a, b):
                h = h * STEP + word[k]
            got = mixed(h + np.uint64(b - a))
        else:
            got = np.empty(0, np.uint64)
        out.append(got)
    return out


class MinHash:
    """Multiply-add permutations of 32 bits."""

    def __init__(self, n: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.a = r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        out = None
        for k in range(0, len(x), 2048):
            part = (x[k : k + 2048, None] * self.a + self.b).min(0)
            out = part if out is None else np.minimum(out, part)
        return out
