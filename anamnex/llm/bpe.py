"""Byte-level BPE encoding and decoding by contiguous rank arrays.

Each short word is held as a row of parts beside a row of the ranks of adjacent pairs. Again and again the least
rank is found, its boundary is deleted, and the two neighbouring ranks are looked up anew. Words of one byte length
are worked on together, as they always have the same number of parts left. Words of over SHORT bytes keep their
parts in a linked list with a heap of ranks, so that time stays near linear.

Null texts count as empty; an empty text has no ids. Any text decodes to itself. Very long texts are cut into parts where
the tokenizer cuts anyway, and a word of any length is one word. Rows and other columns pass through as they are, repeated
rows too; input columns with the name of an output are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import chunks, list_array, with_columns

#: How the byte-level tokenizer cuts text into words (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII and accented Latin letters, for the standard library's faster engine.
LATIN_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+"
NOT_LATIN = r"[^\t\n\r -~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f]"
SHORT = 64
#: Words that a worker remembers; beyond that it forgets all and starts anew.
CACHE_WORDS = 200_000
NONE = np.int32(2**31 - 1)


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Numbers(dict):
    """Numbers of words in the order of their first use; new holds those that are not encoded yet."""

    def __init__(self, pairs):
        super().__init__(pairs)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class RankArrayBpe:
    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        symbols = byte_symbols()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.pieces = {i: bytes(symbols[c] for c in t) for t, i in vocab.items()}
        self.pieces |= {i: t.encode() for t, i in self.added.items()}
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in symbols.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.pairs: dict[int, int] | None = None
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words, self.latin_words, self.not_latin = regex.compile(WORDS), re.compile(LATIN_WORDS), re.compile(NOT_LATIN)
        n = max(self.pieces) + 1
        self.piece_len = np.array([len(self.pieces.get(i, b"")) for i in range(n)], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)])
        self.piece_bytes = np.frombuffer(b"".join(self.pieces.get(i, b"") for i in range(n)), np.uint8)
        self.forget()

    def forget(self) -> None:
        """The cache: a word's number, and by number where its ids start in one flat array, and how many they are."""
        self.number = Numbers((t, k) for k, t in enumerate(self.added))
        self.sizes = np.ones(len(self.added), np.int64)
        self.starts = np.arange(len(self.added), dtype=np.int64)
        self.flat = np.array(list(self.added.values()), np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NONE)

    def same_length(self, parts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of words that all have as many bytes; parts: their byte ids, a row each. Returns blocks (rows, ids) of words that ended with as many ids."""
        out = []
        rows = np.arange(len(parts))
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        while len(rows):
            if not ranks.shape[1]:
                out.append((rows, parts))
                break
            at = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), at]
            if (ended := least == NONE).any():
                out.append((rows[ended], parts[ended]))
                go = ~ended
                rows, parts, ranks, at, least = rows[go], parts[go], ranks[go], at[go], least[go]
                if not len(rows):
                    break
            line = np.arange(len(rows))
            parts[line, at] = self.merged[least]
            keep = np.arange(parts.shape[1]) != (at + 1)[:, None]
            parts = parts[keep].reshape(len(rows), -1)  # the boundary goes
            keep = np.arange(ranks.shape[1]) != at[:, None]
            ranks = ranks[keep].reshape(len(rows), -1)
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.rank(parts[has, at[has] - 1], parts[has, at[has]])
            has = np.flatnonzero(at < ranks.shape[1])
            ranks[has, at[has]] = self.rank(parts[has, at[has]], parts[has, at[has] + 1])
        return out

    def rank_of_pair(self) -> dict[int, int]:
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        return self.pairs

    def long_word(self, word: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.rank(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)

        ranked = self.rank_of_pair()

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (r := ranked.get(ids[i] << 32 | ids[after[i]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            if not live[i] or after[i] >= n or ids[i] != a or ids[after[i]] != b:
                continue
            j = after[i]
            ids[i], live[j], after[i] = int(self.merged[r]), False, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return np.array([x for x, k in zip(ids, live) if k], np.int32)

    def learn(self, words: list[str]) -> None:
        """Encode words that got numbers, in their order, and add them to the cache."""
        by_length: dict[int, list[int]] = {}
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        for k, w in enumerate(raw):
            by_length.setdefault(len(w), []).append(k)
        blocks: list[tuple[np.ndarray, np.ndarray]] = []  # places of words, and as many ids for each
        for n, own in by_length.items():
            if n > SHORT:
                blocks += [(np.array([k]), self.long_word(raw[k])[None, :]) for k in own]
            else:
                places = np.array(own)
                made = self.same_length(self.byte_ids[np.frombuffer(b"".join([raw[k] for k in own]), np.uint8).reshape(len(own), n)])
                blocks += [(places[rows], ids) for rows, ids in made]
        sizes = np.zeros(len(words), np.int64)
        for rows, ids in blocks:
            sizes[rows] = ids.shape[1]
        starts = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.int32)
        for rows, ids in blocks:
            flat[(starts[rows][:, None] + np.arange(ids.shape[1])).ravel()] = ids.ravel()
        self.starts = np.concatenate([self.starts, len(self.flat) + starts])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])

    def cut(self, text: str) -> list[str]:
        """The words of a text; added tokens stand alone."""
        if self.split is None or not any(t in text for t in self.added):
            return (self.words if self.not_latin.search(text) else self.latin_words).findall(text)
        out: list[str] = []
        for part in self.split.split(text):
            if part in self.added:
                out.append(part)
            else:
                out += self.words.findall(part)
        return out

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the offsets of texts among them."""
        if any(len(t) > PART for t in texts):
            return self.encode_long(texts)
        return self.encode_words([self.cut(t) for t in texts])

    def encode_words(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > CACHE_WORDS:
            self.forget()
        counts = np.fromiter(map(len, words), np.int64, len(words))
        used = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, counts.sum())
        if self.number.new:
            self.learn(self.number.new)
            self.number.new = []
        each = self.sizes[used]
        ids = gather(self.flat, self.starts[used], each)
        return ids, offsets_of(each)[offsets_of(counts)]

    def encode_long(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As encode_batch, a part of a text at a time."""
        got, ends, total = [np.empty(0, np.int32)], [0], 0
        for t in texts:
            for p in [t] if self.split is not None and any(" " in a for a in self.added) else parts(t):
                got.append(self.encode_words([self.cut(p)])[0])
                total += len(got[-1])
            ends.append(total)
        return np.concatenate(got), np.array(ends, np.int64)

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of runs of ids; bytes that are no UTF-8 become the replacement character."""
        sizes = self.piece_len[ids]
        raw = gather(self.piece_bytes, self.piece_at[ids], sizes).tobytes()
        at = offsets_of(sizes)[offsets].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]


#: Characters of a text that are encoded at once, where it can be cut.
PART = 1 << 20
#: Places where any text may be cut: a word always ends before a space that stands between two letters.
SAFE = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")


def parts(text: str, most: int | None = None) -> list[str]:
    """A text in parts of about `most` characters (PART) that encode as the whole does; one part where no place is safe."""
    most = most or PART
    out, start = [], 0
    while len(text) - start > most:
        place = SAFE.search(text, start + most)
        if place is None:
            break
        out.append(text[start : place.start()])
        start = place.start()
    return [*out, text[start:]]


def offsets_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[start:start + size], one after the other."""
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return flat[shift + np.arange(len(shift))]


@lru_cache(maxsize=2)
def codec(path: str) -> RankArrayBpe:
    return RankArrayBpe(path)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Append the ids of a text column as array<int>."""

    def make(column: pa.Array) -> list:
        own, got, ends = codec(path), [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        texts = [t or "" for t in column.to_pylist()]
        for a, b in chunks(texts):
            ids, offsets = own.encode_batch(texts[a:b])
            ends.append(offsets[1:] + ends[-1][-1])
            got.append(ids)
        return [list_array(np.concatenate(got), np.concatenate(ends), pa.int32())]

    return with_columns(df, [text], [T.StructField(out, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the text of an array<int> column of ids; null ids give an empty text."""

    def make(column: pa.Array) -> list:
        column = column.fill_null([]) if column.null_count else column
        offsets = column.offsets.to_numpy().astype(np.int64)
        flat = column.values.to_numpy(zero_copy_only=False)
        own, out_texts, start = codec(path), [], 0
        while start < len(column):  # about a million ids at once
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + (1 << 20), "right")) - 1)
            end = min(end, len(column))
            out_texts += own.decode_batch(flat[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
            start = end
        return [pa.array(out_texts, pa.string())]

    return with_columns(df, [ids], [T.StructField(out, T.StringType())], make)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """encode and decode in one pass of Python workers: appends ids and decoded."""

    def make(column: pa.Array) -> list:
        own, got, ends, back = codec(path), [np.empty(0, np.int32)], [np.zeros(1, np.int64)], []
        texts = [t or "" for t in column.to_pylist()]
        for a, b in chunks(texts):
            ids, offsets = own.encode_batch(texts[a:b])
            back += own.decode_batch(ids, offsets)
            ends.append(offsets[1:] + ends[-1][-1])
            got.append(ids)
        return [list_array(np.concatenate(got), np.concatenate(ends), pa.int32()), pa.array(back, pa.string())]

    return with_columns(df, [text], [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], make)
