"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over the words of all documents. Its table is bounded by the cube of a fixed
   alphabet; what is gathered for it (partial counts of every task) grows with the input.
2. Tokens that look disguised (leetspeak, separators inside, letters set apart, repeated letters) become lattices: each
   character may stand for itself, for a letter it resembles, or for nothing where it repeats or separates. Viterbi
   decoding under the character model picks the likeliest spelling; its time is linear, and tokens of any length are
   decoded. Marks at either end that resemble letters are part of the lattice as well. When a document is scored, a separator or a gap
   between letters set apart may also be the end of a word, and a repeat of any length may be dropped: every word of
   these readings is looked up; between letters set apart, if a reading with it is at most MARGIN dearer than the best.
3. The restored words and their beginnings are scored, and beginnings that two or more different words of a document
   share, as one such word may be chance where several are not. A feature counts if, in the training documents, its share of
   toxic documents is at least STRONG, and above the base rate beyond chance (a Chernoff bound, held against the number
   of features), and still LEFT_STRONG once the documents of all stronger features are taken away, or else beyond
   chance as at first once those of any one of them are. A document's score is the noisy-or over its words.

Training documents are the labelled ones outside the held-out fold, at most `most` of them, by hash of the id. Labels,
language, source and id are never inputs of a score. Null and empty texts get the score of a document without
evidence, and so does every text where there are no labels. Labels that disagree count as toxic; rows with a null id or
label teach nothing. Repeated rows count as often as they occur and get equal scores; the whole of a very long text
counts. Other columns pass through; an input column with the name of the output is replaced. An empty table gives one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, chunks, with_columns

THRESHOLD = 0.3
MOST_TRAINING = 20_000
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåæçéèêëíìîïñóòôöõøœúùûüýÿß"
OTHER, EDGE = "?", "^"
#: What a character of a disguised word may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "§": "s",
}
LEET_COST, DROP_SEPARATOR, DROP_OTHER = 1.0, 0.5, 4.0
#: What it costs to drop the second of equal characters in a row, which may be a true double, and each further one.
DROP_SECOND, DROP_REPEAT = 3.0, 0.5
#: Marks that rather stand for letters than between them, and what it costs to drop others at the ends of a word.
LETTER_MARKS, DROP_AT_END = "@$€£¡§", 0.1
#: What is no letter of any disguise, and goes from the ends of a token.
STRIP = "?.,;:\"')[]{}>*#%&~^`«»…–—-_=/\\"
PUNCTUATION = "!|(<+"
MARK_LETTERS = "".join(c for c in LEET if not c.isalnum())
REPEATED = re.compile(r"(.)\1\1")
DOUBLED = re.compile(r"(.)\1", re.DOTALL)
REPEAT = re.compile(r"(.)\1*", re.DOTALL)
APART = re.compile(r"(?<!\S)(?:\w[ ._*-]{1,2}){3,}\w(?!\S)")
GAP = re.compile(r"[ ._*-]+")
#: Marks that end a word inside a token: those that stand for no letter, and all.
MARKS = [re.compile(f"(?:[^\\w{re.escape(MARK_LETTERS)}]|_)+"), re.compile(r"(?:[^\w]|_)+")]
#: How much dearer than the best a reading of letters set apart may be, and how long its words are.
MARGIN, LONGEST_WORD = 8.0, 24
#: Tokens whose evidence a worker remembers, and how long they may be.
KNOWN_TOKENS, KNOWN_CHARS = 200_000, 64
#: Words whose trigrams are counted at once.
COUNTED_WORDS = 50_000
EVIDENCE_LEAST = 5
#: Least share of toxic documents among those with a feature.
STRONG = 0.5
#: The same among the documents that stronger features have left.
LEFT_STRONG = 0.8


def folded(word: str) -> str:
    return "".join(c if c in LETTERS else OTHER for c in word)


def core(token: str) -> str:
    return token.strip(STRIP)


def disguised(word: str) -> bool:
    if len(word) < 2:
        return False
    if word.strip(PUNCTUATION).isalpha():
        return REPEATED.search(word.strip(PUNCTUATION)) is not None
    if any(c.isalpha() for c in word):
        return True
    marks = sum(c in MARK_LETTERS for c in word)  # all of letters' lookalikes, and not a price or a row of marks
    return 2 * marks >= len(word) and len(set(word)) > 1 and all(c in LEET for c in word)


@dataclass
class CharModel:
    """Costs (negative log probabilities) of a character after two others."""

    costs: dict[str, float] = field(default_factory=dict)
    floor: dict[str, float] = field(default_factory=dict)

    @classmethod
    def of(cls, counts: dict[str, int]) -> CharModel:
        pair: Counter = Counter()
        single: Counter = Counter()
        for gram, n in counts.items():
            pair[gram[:2]] += n
            single[gram[2]] += n
        total, size = sum(single.values()) or 1, len(LETTERS) + 2
        p1 = {c: (single[c] + 1) / (total + size) for c in [*LETTERS, OTHER, EDGE]}
        costs = {g: -math.log((n + 5 * p1[g[2]]) / (pair[g[:2]] + 5)) for g, n in counts.items()}
        floor = {p: -math.log(5 / (n + 5)) for p, n in pair.items()}
        return cls(costs, floor | {"": 0.0} | {c: -math.log(p) for c, p in p1.items()})

    def cost(self, gram: str) -> float:
        found = self.costs.get(gram)
        return self.floor.get(gram[:2], 0.0) + self.floor[gram[2]] if found is None else found


def lattice(word: str, all_letters: bool = False) -> list[list[tuple[str, float]]]:
    """For each character: the letters that it may stand for, or nothing, with costs. all_letters: what can be a letter is one."""
    inner = word.strip(MARK_LETTERS)
    start = word.find(inner) if inner else len(word)
    stop, out = start + len(inner), []
    for k, c in enumerate(word):
        options = [(c, 0.0)] if c.isalpha() else []
        options += [(x, LEET_COST) for x in LEET.get(c, "")]
        end = not start <= k < stop
        if options and all_letters:
            drop = None
        elif word[k - 1 : k] == c:
            drop = DROP_REPEAT if not options or word[k - 2 : k - 1] == c else DROP_SECOND
        elif c.isalpha():
            drop = None
        elif c.isdigit() or end and c in LETTER_MARKS:
            drop = DROP_OTHER
        else:
            drop = DROP_AT_END if end else DROP_SEPARATOR
        out.append(options if drop is None else [*options, ("", drop)])
    return out


def decoded(word: str, model: CharModel, all_letters: bool = False) -> tuple[float, str]:
    """Cost and letters of the best path through a word's lattice. A state is the last two characters."""
    states: dict[str, tuple[float, tuple | None]] = {EDGE + EDGE: (0.0, None)}
    for options in lattice(word, all_letters):
        new: dict[str, tuple[float, tuple | None]] = {}
        for key, (cost, path) in states.items():
            for x, more in options:
                if x:
                    f = x if x in LETTERS else OTHER
                    to, total, way = key[1] + f, cost + more + model.cost(key + f), (path, x)
                else:
                    to, total, way = key, cost + more, path
                got = new.get(to)
                if got is None or total < got[0]:
                    new[to] = (total, way)
        states = new
    cost, _, path = min((cost + model.cost(key + EDGE), key, path) for key, (cost, path) in states.items())
    letters = []
    while path is not None:
        path, x = path
        letters.append(x)
    return cost, "".join(reversed(letters))


def restore_word(word: str, model: CharModel, all_letters: bool = False) -> str:
    """The likeliest spelling of a disguised word."""
    return decoded(word, model, all_letters)[1]


def features(word: str) -> list[str]:
    out = ["=" + word]
    if len(word) > 4:
        out.append("4" + word[:4])
    if len(word) > 5:
        out.append("5" + word[:5])
    return out


#: Letters of a beginning that several words share.
SHARED = 5


def document_features(words: set[str]) -> set[str]:
    """Features of the words, and of beginnings that more than one of them has."""
    shared = Counter(w[:SHARED] for w in words if len(w) >= SHARED)
    return {f for w in words if w for f in features(w)} | {"2" + b for b, n in shared.items() if n > 1}


def restored_word(token: str, model: CharModel) -> str:
    word = core(token)
    return restore_word(word, model) if disguised(word) else word.strip(MARK_LETTERS)


def set_apart(text: str) -> list[str]:
    """Words whose letters stand apart, with the gaps closed."""
    return [GAP.sub("", m[0]) for m in APART.finditer(text)]


def letter_runs(word: str) -> list[str]:
    return [m[0] for m in REPEAT.finditer(word)]


def pieces(token: str) -> set[str]:
    """What a token may hold besides itself: its parts between marks, and neighbouring parts as one of up to LONGEST_WORD letters, repeats not counted."""
    word, out = core(token), set()
    for mark in MARKS:
        parts: list[str] = []
        for p in mark.split(word):
            if p and not (len(p) == 1 and parts[-2:] == [p, p]):
                parts.append(p)
        for i in range(len(parts)):
            joined, letters = "", 0
            for p in parts[i:]:
                letters += len(letter_runs(p)) - (joined[-1:] == p[0])
                if joined and letters > LONGEST_WORD:
                    break
                joined += p
                out.add(joined)
    out.discard(word)
    return out


def plain_letters(run: str, model: CharModel) -> set[str]:
    """Letters set apart, with letters for what resembles them."""
    if run.isalpha():
        return {run}
    return {"".join(c if c.isalpha() else LEET.get(c, "")[k:][:1] for c in run) for k in (0, -1)} | {restore_word(run, model)}


def readings(run: str, model: CharModel, at: list[tuple[int, int]]) -> list[bool]:
    """Of words in a run of letters, by place: whether words that fill the run with it among them are likely enough."""
    n, far = len(run), math.inf
    costs = []
    for a in range(n):
        own, key, total = [], EDGE + EDGE, 0.0
        for c in folded(run[a : a + LONGEST_WORD]):
            total += model.cost(key + c)
            key = key[1] + c
            own.append(total + model.cost(key + EDGE))
        costs.append(own)
    before, after = [0.0] + [far] * n, [far] * n + [0.0]
    for a in range(n):
        for k, cost in enumerate(costs[a], a + 1):
            before[k] = min(before[k], before[a] + cost)
    for a in reversed(range(n)):
        after[a] = min(cost + after[k] for k, cost in enumerate(costs[a], a + 1))
    return [before[a] + costs[a][b - a - 1] + after[b] <= after[0] + MARGIN for a, b in at]


SYMBOLS = LETTERS + OTHER + EDGE
_SYMBOL = np.full(0x250, len(LETTERS), np.int64)  # others are OTHER
_SYMBOL[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
_SYMBOL[ord(EDGE)] = len(LETTERS) + 1


def gram_counts(words: dict[str, int]) -> np.ndarray:
    """How often each trigram (a number of base len(SYMBOLS)) occurs in words with their ends, which occur so often."""
    if not words:
        return np.zeros(len(SYMBOLS) ** 3)
    codes = np.frombuffer("".join(f"{EDGE}{EDGE}{w}{EDGE}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.where(codes < len(_SYMBOL), _SYMBOL[np.minimum(codes, len(_SYMBOL) - 1)], len(LETTERS))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 3
    times = np.repeat(np.fromiter(words.values(), np.float64, len(words)), sizes)
    ends = np.cumsum(sizes)
    times[ends - 1] = times[ends - 2] = 0  # no trigram of a word starts at its last two places
    k = len(SYMBOLS)
    grams = (of[:-2] * k + of[1:-1]) * k + of[2:]
    return np.bincount(grams, times[:-2], k**3)


def char_counts(df: DataFrame, text: str = "text") -> dict[str, int]:
    """Trigrams of all words of all texts, with how often they occur; bounded by the alphabet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams = np.zeros(len(SYMBOLS) ** 3)

        def plain() -> dict[str, int]:
            kept: dict[str, int] = {}
            for token, n in words.items():
                w = token if token.isalpha() else core(token).strip(MARK_LETTERS)
                if w.isalpha():
                    kept[w] = kept.get(w, 0) + n
            words.clear()
            return kept

        for b in batches:
            for t in b.column(0):
                words.update((t.as_py() or "").lower().split())
                if len(words) > COUNTED_WORDS:
                    grams += gram_counts(plain())
        grams += gram_counts(plain())
        found, k = np.flatnonzero(grams), len(SYMBOLS)
        names = [SYMBOLS[g // k // k] + SYMBOLS[g // k % k] + SYMBOLS[g % k] for g in found.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(grams[found].astype(np.int64))], names=["gram", "n"])

    found = df.select(text).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in found.collect()}  # at most (len(LETTERS) + 2) ** 3 rows


def training_ids(labels: DataFrame, most: int, doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    labels = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("toxic"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


@dataclass
class Model:
    chars: CharModel
    weights: dict[str, float]
    none: float

    def __post_init__(self):
        self.starts = {f[1] for f in self.weights if len(f) > 1}  # first letters of what is evidence
        #: The first two letters of evidence, repeats not counted. A word with none of them in front is no evidence, unless its first letter repeats.
        self.heads = {"".join(r[0] for r in letter_runs(f[1:])[:2]) for f in self.weights if len(f) > 1}
        self.by_letters: dict[str, list[tuple[list[int], float]]] = {}
        for f, p in self.weights.items():
            if f[0] == "=" and len(f) > 1:
                own = letter_runs(f[1:])
                self.by_letters.setdefault("".join(r[0] for r in own), []).append(([len(r) for r in own], p))

    def scores(self, texts: list[str], known: dict[str, tuple[float, str]]) -> list[float]:
        """known: the evidence of tokens that were met before, and the word that each is if its beginning counts when shared."""
        out, heads = [], self.heads
        for text in texts:
            text = text.lower()
            clean, sharing = 1 - self.none, set()
            for t in set(text.split()):
                if t.isalpha() and t[:2] not in heads and t[:1] != t[1:2]:
                    continue  # no spelling of it begins as evidence does
                if (found := known.get(t)) is None:
                    found = self.evidence(t), self.sharing(t)
                    if len(t) <= KNOWN_CHARS:
                        if len(known) > KNOWN_TOKENS:
                            known.clear()
                        known[t] = found
                p, word = found
                if p:
                    clean *= 1 - p
                if word:
                    sharing.add(word)
            for beginning, n in Counter(w[:SHARED] for w in sharing).items():
                if n > 1:
                    clean *= 1 - self.weights["2" + beginning]
            for m in APART.finditer(text):
                clean *= 1 - self.evidence_apart(m[0])
            out.append(1 - clean)
        return out

    def evidence(self, token: str) -> float:
        word = core(token)
        best = self.read(word)
        if not word.isalpha():
            for piece in pieces(token):
                if piece[0] not in LETTERS or piece[0] in self.starts:
                    best = max(best, self.read(core(piece)))
        return best

    def sharing(self, token: str) -> str:
        """The word that a token is, if its beginning is evidence once several words share it; or ''."""
        word = restored_word(token, self.chars)
        return word if len(word) >= SHARED and "2" + word[:SHARED] in self.weights else ""

    def read(self, word: str) -> float:
        """The weight of the likeliest spelling, and of the one where all that can be a letter is one."""
        best = self.weight(restored_word(word, self.chars))
        if disguised(word) or not word.isalpha() and any(c.isalpha() or c in MARK_LETTERS for c in word):
            best = max(best, self.weight(restore_word(word, self.chars, True)))
        return best

    def evidence_apart(self, gapped: str) -> float:
        run = GAP.sub("", gapped)  # single letters that are words may stand at either end
        best = max(self.evidence(run[a : len(run) - b]) for a in range(3) for b in range(3))
        best = max([best, *(self.evidence(GAP.sub("", part)) for part in gapped.split("  "))])
        for letters in plain_letters(run, self.chars):
            places = range(len(letters))
            found = [(p, a, b) for a in places if letters[a] in self.starts for b in range(a + 1, min(a + LONGEST_WORD, len(letters)) + 1) if (p := self.weight(letters[a:b])) > best]
            if found:
                likely = readings(letters, self.chars, [(a, b) for _, a, b in found])
                best = max([best, *(p for (p, _, _), fine in zip(found, likely) if fine)])
        return best

    def weight(self, word: str) -> float:
        """The weight of a word, or the largest of its spellings where repeats of a letter, however long, are one letter or two."""
        if word[:2] not in self.heads and word[:1] != word[1:2]:
            return 0.0
        best = self.own_weight(word)
        if not DOUBLED.search(word):
            return best
        runs = letter_runs(word)
        for sizes, p in self.by_letters.get("".join(r[0] for r in runs), ()):
            if p > best and all(n <= len(r) and (n <= 2 or n == len(r)) for n, r in zip(sizes, runs)):
                best = p
        more = sum(min(2, len(r)) for r in runs[5:])  # beginnings lie in the first five
        for x in product(*((r[0], r[:2])[: len(r)] for r in runs[:5])):
            head = "".join(x)
            for n in (4, 5):
                if len(head) >= n and len(head) + more > n:
                    best = max(best, self.weights.get(str(n) + head[:n], 0.0))
        return best

    def own_weight(self, word: str) -> float:
        weights = self.weights
        return max(weights.get("=" + word, 0.0), weights.get("4" + word[:4], 0.0) if len(word) > 4 else 0.0, weights.get("5" + word[:5], 0.0) if len(word) > 5 else 0.0)


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINING, text: str = "text", doc_id: str = "doc_id") -> Model:
    """The character model of all docs, and the weights of features from the training documents."""
    scratch = Scratch(docs.sparkSession)
    chars = CharModel.of(char_counts(docs, text))
    ids = scratch.write(training_ids(labels, most))
    n, toxic = ids.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rate = min(0.9, max(0.001, toxic / n if n else 0.001))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), "doc_id").select("text", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos: Counter = Counter()
        every: Counter = Counter()
        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist()):
                low = (t.as_py() or "").lower()
                words = {restored_word(x, chars) for x in set(low.split()) | set(set_apart(low))}
                found = document_features(words)
                every.update(found)
                if y:
                    pos.update(found)
        names = list(every)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([pos[f] for f in names], pa.int64()), pa.array([every[f] for f in names], pa.int64())], names=["feature", "pos", "n"])

    counted = scratch.write(own.mapInArrow(run, "feature string, pos long, n long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).where(f"n >= {EVIDENCE_LEAST}"))
    share = F.col("pos") / F.col("n")
    other = F.when(share < 1, (1 - share) * F.ln((1 - share) / (1 - rate))).otherwise(0.0)
    gain = F.when(share > rate, F.col("n") * (share * F.ln(share / rate) + other)).otherwise(0.0)
    enough = math.log(2 * max(1, counted.count()))
    strong = [r["feature"] for r in counted.where((gain > enough) & (share >= STRONG)).select("feature").collect()]  # bounded by the training documents
    number = {f: k for k, f in enumerate(strong)}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(0):
                low = (t.as_py() or "").lower()
                words = {restored_word(x, chars) for x in set(low.split()) | set(set_apart(low))}
                rows.append(sorted({number[f] for f in document_features(words) if f in number}))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.list_(pa.int32()))], names=["toxic", "own"])

    found = own.mapInArrow(held, "toxic int, own array<int>").where(F.size("own") > 0).toArrow()  # at most `most` rows
    weights = {strong[k]: p for k, p in decision_list(found["own"].to_pylist(), found["toxic"].to_pylist(), len(strong), rate, math.log(2 * max(1, len(strong))), enough)}
    return Model(chars, weights, min(0.1, rate / 5))


def evidence_of(n: int, positive: int, rate: float) -> float:
    """How far n documents, of which so many are toxic, are beyond chance, as a logarithm; 0 below LEFT_STRONG."""
    p = positive / max(1, n)
    if p < LEFT_STRONG:
        return 0.0
    return n * (p * math.log(p / rate) + ((1 - p) * math.log((1 - p) / (1 - rate)) if p < 1 else 0.0))


def decision_list(own: list[list[int]], toxic: list[int], size: int, rate: float, enough: float, sure: float = math.inf) -> list[tuple[int, float]]:
    """Features one after the other, each by what it says of the documents that none before it is in.

    Words that only stand beside a telling word, as in copies of one document, say nothing once its documents are gone.
    enough: the evidence that a feature must still have, as a logarithm; only features that passed the first test come
    here. Others count as well if no single one of those before explains them: without the documents of any one, what is
    left must be as sure as in the first test.
    """
    docs: list[list[int]] = [[] for _ in range(size)]
    pos, every = [0] * size, [0] * size
    for d, (fs, y) in enumerate(zip(own, toxic)):
        for f in fs:
            docs[f].append(d)
            every[f] += 1
            pos[f] += y
    whole = list(zip(every, pos))
    gone, out = [False] * len(own), []
    while size:
        best = max(range(size), key=lambda f: (evidence_of(every[f], pos[f], rate), -f))
        if evidence_of(every[best], pos[best], rate) <= enough:
            break
        out.append((best, (pos[best] + 0.5) / (every[best] + 1)))
        for d in docs[best]:
            if not gone[d]:
                gone[d] = True
                for f in own[d]:
                    every[f] -= 1
                    pos[f] -= toxic[d]
    chosen = {f for f, _ in out}
    for f in set(range(size)) - chosen:
        n, positive = whole[f]
        beside = Counter(g for d in docs[f] for g in own[d] if g in chosen)
        beside_toxic = Counter(g for d in docs[f] if toxic[d] for g in own[d] if g in chosen)
        if evidence_of(n, positive, rate) > sure and all(evidence_of(n - k, positive - beside_toxic[g], rate) > sure for g, k in beside.items()):
            out.append((f, (positive + 0.5) / (n + 1)))
    return out


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Append the score (0 to 1) of a text column."""
    known: dict[str, tuple[float, str]] = {}

    def make(column: pa.Array) -> list:
        return [pa.array(model.scores([t.as_py() or "" for t in column], known), pa.float64())]

    return with_columns(docs, [text], [T.StructField(out, T.DoubleType())], make)


def restore(docs: DataFrame, chars: CharModel, text: str = "text", out: str = "restored") -> DataFrame:
    """Append the text in lower case with disguised words spelt out; words stand one space apart."""

    def make(column: pa.Array) -> list:
        texts, done = [t or "" for t in column.to_pylist()], []
        for a, b in chunks(texts):
            for t in texts[a:b]:
                low = APART.sub(lambda m: re.sub(r"[ ._*-]+", "", m[0]), t.lower())
                done.append(" ".join(w for w in (restored_word(x, chars) for x in low.split()) if w))
        return [pa.array(done, pa.string())]

    return with_columns(docs, [text], [T.StructField(out, T.StringType())], make)
