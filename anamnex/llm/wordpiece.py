"""Token counts by a linear longest-match automaton, without building pieces.

The vocabulary is a trie. A node whose string is a token pops that token and fails to the root; any other node fails to
where its parent's failures lead, and pops what they popped. A text position then takes amortised constant time, and
only the precomputed number of popped tokens is added.

Words are the maximal runs that the word tokenizer's pattern cuts from the normalised text (NFC, white space
collapsed, lower case); each is spelt in bytes, of which the last bears the end-of-word mark. Null texts count as empty
and have no tokens. A vocabulary that cannot spell a word raises: no count would be right. Other columns pass through, and
input columns with the name of an output are replaced; repeated rows get equal counts; words and texts of any length
count whole; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import unicodedata
from collections import deque
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import byte_symbols
from .common import chunks, with_columns

#: How the word tokenizer cuts normalised text (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
CACHE_WORDS = 300_000
MARK = 256


class Automaton:
    """Tokens are sequences of small integers (bytes; MARK more for a byte that ends a word)."""

    def __init__(self, tokens: list[tuple[int, ...]]):
        step: dict[int, int] = {}  # node * 1024 + symbol -> node
        kids: list[list[tuple[int, int]]] = [[]]
        whole = [False]
        for token in tokens:
            at = 0
            for s in token:
                to = step.get(at << 10 | s)
                if to is None:
                    to = step[at << 10 | s] = len(kids)
                    kids[at].append((s, to))
                    kids.append([])
                    whole.append(False)
                at = to
            whole[at] = bool(token)
        fail, pops = [-1] * len(kids), [0] * len(kids)
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for s, v in kids[u]:
                if whole[v]:
                    fail[v], pops[v] = 0, 1
                else:
                    z, n = fail[u], pops[u]
                    while z >= 0 and (z << 10 | s) not in step:
                        n += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = step[z << 10 | s], n
                todo.append(v)
        self.step, self.fail, self.pops = step, fail, pops

    def count(self, word) -> int:
        """Tokens of greedy longest-match-first cutting; -1 if it gets stuck."""
        step, fail, pops, at, n = self.step, self.fail, self.pops, 0, 0
        for s in word:
            while (to := step.get(at << 10 | s)) is None:
                if fail[at] < 0:
                    return -1
                n += pops[at]
                at = fail[at]
            at = to
        while at:
            if fail[at] < 0:
                return -1
            n += pops[at]
            at = fail[at]
        return n


class Counter:
    def __init__(self, path: str):
        symbols = byte_symbols()
        vocab = json.loads(open(path, encoding="utf-8").read())["model"]["vocab"]
        tokens = []
        for t in vocab:
            body = t.removesuffix(END)
            if body and all(c in symbols for c in body):
                codes = [symbols[c] for c in body]
                codes[-1] += MARK * (body != t)
                tokens.append(tuple(codes))
        self.automaton = Automaton(tokens)
        self.words = regex.compile(WORDS)
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> tuple[list[int], list[int]]:
        cut = [self.words.findall(normalised(t)) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, count = self.known, self.automaton.count
        for w in set().union(*cut).difference(known):
            known[w] = n = count((*(b := w.encode("utf-8", "surrogatepass"))[:-1], b[-1] + MARK))
            if n < 0:
                raise ValueError(f"the vocabulary has no tokens for {w[:80]!r}")
        sizes = list(map(len, cut))
        each = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), np.int64, sum(sizes))
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        return sizes, np.diff(ends).tolist()


def normalised(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Append n_words and n_tokens (long) of a text column."""

    def make(column: pa.Array) -> list:
        texts, words, tokens = [t or "" for t in column.to_pylist()], [], []
        for a, b in chunks(texts):
            w, t = counter(path).count(texts[a:b])
            words += w
            tokens += t
        return [pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]

    return with_columns(df, [text], [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())], make)
