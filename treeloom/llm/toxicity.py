"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Kernel: a word's features are its subsequences of three and of four characters within a span of five, each weighted DECAY^gaps;
a mark stands before and after the word, so a word is told from its extensions. Inserted characters and gaps thus shift weight between features but keep most of it. Words stand
in for one another by the normalised inner product. Features are hashed into a table of fixed size that only holds those of the
landmarks, so a word's kernel row against all landmarks is a sum over its few hits, worked out once per distinct word.

Training: documents are labelled, so each is a bag of sentences, and a distinct sentence is clean if any clean document has it, else suspect.
The machine learns which words of suspect sentences carry the label: those that suspect sentences hold far more often than clean
ones, themselves or by a run of four characters they share with others, and for a toxic document without any the word that comes nearest.
Their variants (a letter put in or doubled) are examples, too. A document's evidence is its few most toxic distinct words,
weighed by a logistic curve that is fitted to documents their machine has not seen.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, column, give_back, held_out, mix, slices, texts_of, trimmed, words

DECAY = 0.6
OFFSETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4))
BITS = 22
EDGE = 0x110000  # the mark before and after a word
EVIDENCE = 12.0  # a word or a run of four characters tells from this log likelihood ratio on (suspect sentences against clean ones)
SOFT = 0.0  # the margin of words that are toxic in numbers only; the others' is 1
TOP = 4  # so many distinct words are a document's evidence
FLOOR, CEILING = -1.0, 1.0  # values beyond count as these: a clean word has none below, a toxic one none above
WINDOW = 64  # longer sentences are cut
SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n+")
SPELT = 3  # so many single characters in a row are a word spelt with spaces
_SPACE = np.zeros(0x3002, bool)  # the last entry, no white space, stands for all code points beyond
_SPACE[[i for i in range(0x3001) if chr(i).isspace()]] = True
_KEPT = np.array([chr(i).isalnum() or chr(i).isspace() or i >= 0x80 for i in range(0x3001)])


def features(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, offsets: tuple = OFFSETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, hashed feature, weight) of words given as ranges of code points."""
    n = lengths + 2
    total = int(n.sum())
    word = np.repeat(np.arange(len(starts)), n)
    spot = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
    code = np.full(total + 5, EDGE, np.uint64)
    left = np.repeat(n, n) - spot
    inner = (spot > 0) & (left > 1)
    code[:total][inner] = chars[(np.repeat(starts, n) + spot - 1)[inner]]
    out = []
    at = np.arange(total)
    with np.errstate(over="ignore"):
        for steps in offsets:
            ok = at[left > steps[-1]]
            key = code[ok] + np.uint64(len(steps))
            for i in steps:
                key = key * np.uint64(0x110001) + code[ok + i]
            out.append((word[ok], (mix(key) >> np.uint64(64 - BITS)).astype(np.int64), np.full(len(ok), DECAY ** (steps[-1] - len(steps)))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def by_word(word: np.ndarray, key: np.ndarray, weight: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal features of a word summed; with the words' norms."""
    joint = word << BITS | key
    order = np.argsort(joint, kind="stable")
    joint = joint[order]
    first = np.flatnonzero(np.append(True, joint[1:] != joint[:-1])) if len(joint) else np.zeros(0, np.int64)
    sums = np.add.reduceat(weight[order], first) if len(first) else np.zeros(0)
    owner, feature = joint[first] >> BITS, joint[first] & (1 << BITS) - 1
    return owner, feature, sums, np.sqrt(np.bincount(owner, sums * sums, many))


def spell(own: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    chars, offsets = code_points(own)
    return chars, offsets[:-1], np.diff(offsets)


@dataclass
class Machine:
    """slot: of each hashed feature its row in `rows` (0: no landmark has it); rows: its weight in each landmark, through alpha.
    weights, shift: the logistic curve over a document's TOP values. left, right: hashes of both parts of learned words cut in two."""

    slot: np.ndarray
    rows: np.ndarray
    bias: float
    weights: np.ndarray = field(default_factory=lambda: np.ones(TOP))
    shift: float = 0.0
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def words(self, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The decision value of each word."""
        out = np.zeros(len(starts))
        for a in range(0, len(starts), 2_000):
            word, key, weight = features(chars, starts[a : a + 2_000], lengths[a : a + 2_000])
            many = len(starts[a : a + 2_000])
            hits = np.bincount(word, self.slot[key] > 0, many) > 0  # no hit: the kernel is 0 with every landmark
            keep = hits[word]
            owner, feature, sums, norms = by_word(word[keep], key[keep], weight[keep], many)
            dots = np.bincount(owner, sums * self.rows[self.slot[feature]], many)
            out[a : a + 2_000] = dots / np.maximum(norms, 1e-12)
        return out + self.bias

    def probability(self, tops: np.ndarray) -> np.ndarray:
        """Of documents given by their TOP values in falling order."""
        return 1 / (1 + np.exp(-np.clip(tops @ self.weights + self.shift, -30, 30)))


def kernel(own: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of words with landmarks."""
    a = by_word(*features(*spell(own)), len(own))
    b = by_word(*features(*spell(landmarks)), len(landmarks))
    seen = np.unique(b[1])
    dense = np.zeros((len(seen) + 1, len(landmarks)), np.float32)
    dense[np.searchsorted(seen, b[1]) + 1, b[0]] = b[2]
    at = np.searchsorted(seen, a[1])
    at[at == len(seen)] = 0
    at = np.where(len(seen) and seen[at] == a[1], at + 1, 0) if len(seen) else np.zeros(len(a[1]), np.int64)
    keep = at > 0
    out = np.zeros((len(own), len(landmarks)))
    owner, sums, at = a[0][keep], a[2][keep], at[keep]
    for i in range(0, len(own), 100):
        lo, hi = np.searchsorted(owner, [i, i + 100])
        if lo < hi:
            firsts = np.flatnonzero(np.append(True, owner[lo + 1 : hi] != owner[lo : hi - 1]))
            out[owner[lo:hi][firsts]] = np.add.reduceat(sums[lo:hi, None].astype(np.float32) * dense[at[lo:hi]], firsts)
    return out / np.maximum(a[3], 1e-12)[:, None] / np.maximum(b[3], 1e-12)[None]


def svm(x: np.ndarray, y: np.ndarray, margin: np.ndarray, weight: np.ndarray, cost: float) -> np.ndarray:
    """Linear machine with squared hinge loss below each example's margin by Newton steps; the last column of x is 1 and its coefficient the bias."""
    w = np.zeros(x.shape[1])
    reg = np.append(np.ones(x.shape[1] - 1), 1e-3)
    for _ in range(30):
        gram, side = np.diag(reg), np.zeros(x.shape[1])
        for a in range(0, len(x), 1000):  # sums in double precision, a block at a time
            part, own = x[a : a + 1000].astype(np.float64), slice(a, a + 1000)
            active = y[own] * (part @ w) < margin[own]
            part, each = part[active], cost * weight[own][active]
            gram += (part * each[:, None]).T @ part
            side += part.T @ (each * (y[own] * margin[own])[active])
        new = np.linalg.solve(gram, side)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def plain(text: str) -> str:
    """The text in lower case without ASCII punctuation, which also hides nothing inside a word."""
    return re.sub(r"[^\w\s\x80-\U0010ffff]|_", "", text.lower())


def own_words(text: str) -> list[str]:
    """The words of a text made plain; before a run of SPELT or more single characters the word they spell."""
    return with_spelt(plain(text).split())


def with_spelt(own: list[str]) -> list[str]:
    if list(map(len, own)).count(1) < SPELT:
        return own
    out: list[str] = []
    for one, run in groupby(own, lambda w: len(w) == 1):
        run = list(run)
        if one and len(run) >= SPELT:
            out.append("".join(run))
        out += run
    return out


def spelt(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, code points, starts in them, lengths) of the words that runs of SPELT or more single characters spell."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    one = np.flatnonzero(lengths == 1)
    new = np.append(True, (np.diff(one) > 1) | (np.diff(owner[one]) > 0))[: len(one)]
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(one)))
    keep = many >= SPELT
    return owner[one[first[keep]]], chars[starts[one]], first[keep], many[keep]


def apart(ranked: list[str], many: int, near: float = 0.5) -> list[str]:
    """The first words of the ranking that are no closer than `near` to one before."""
    chosen: list[str] = []
    for a in range(0, len(ranked), 150):
        block = ranked[a : a + 150]
        if len(chosen) >= many:
            break
        close = kernel(block, chosen).max(axis=1) if chosen else np.zeros(len(block))
        inner, taken = kernel(block, block), []
        for i, w in enumerate(block):
            if close[i] < near and not (taken and inner[i, taken].max() >= near):
                taken.append(i)
                chosen.append(w)
    return chosen[:many]


def machine_of(marks: list[str], pos: list[str], neg: list[str], margin: np.ndarray, up: np.ndarray, down: np.ndarray, cost: float) -> Machine:
    """Nyström map over the landmarks, linear machine, and its decision folded into a weight for each feature."""
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    both = pos + neg
    x = np.ones((len(both), root.shape[1] + 1), np.float32)
    for a in range(0, len(both), 500):
        x[a : a + 500, :-1] = kernel(both[a : a + 500], marks) @ root
    w = svm(x, np.append(np.ones(len(pos)), -np.ones(len(neg))), np.append(margin, np.ones(len(neg))), np.append(up, down / max(1e-9, down.sum()) * np.sqrt(up).sum() * 20), cost)
    alpha = root @ w[:-1]
    owner, feature, sums, norms = by_word(*features(*spell(marks)), len(marks))
    seen = np.unique(feature)
    rows = np.zeros(len(seen) + 1)
    np.add.at(rows, np.searchsorted(seen, feature) + 1, sums * (alpha / np.maximum(norms, 1e-12))[owner])
    slot = np.zeros(1 << BITS, np.int32)
    slot[seen] = np.arange(1, len(seen) + 1)
    return Machine(slot, rows, float(w[-1]))


def variants(word: str, letters: str, many: int = 16) -> list[str]:
    """The word with each of its inner letters doubled, and with a letter put in at places drawn by the word itself."""
    draw = random.Random(word)
    put = {word[:i] + draw.choice(letters) + word[i:] for i in (draw.randrange(1, len(word)) for _ in range(many))}
    return sorted({word[:i] + word[i] + word[i:] for i in range(len(word))} | put)


def likelihood(c1: np.ndarray, c0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The log likelihood ratio of counts in n1 suspect and n0 clean sentences; 0 for what is no likelier in suspect ones."""
    share, base = np.clip(c1 / np.maximum(c1 + c0, 1), 1e-12, 1 - 1e-12), n1 / max(1, n0 + n1)
    base = min(max(base, 1e-9), 1 - 1e-9)
    return np.where(share > base, c1 * np.log(share / base) + c0 * np.log((1 - share) / (1 - base)), 0.0)


@dataclass
class Bags:
    """Labelled documents as bags of sentences of words. names: the distinct words; docs: distinct words of each document;
    sentence, word: pairs, each once; first, suspect: of each distinct sentence its first document and whether only toxic ones have it."""

    names: list[str]
    labels: np.ndarray
    docs: list[np.ndarray]
    sentence: np.ndarray
    word: np.ndarray
    first: np.ndarray
    suspect: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str, int]]) -> Bags:
        index: dict[str, int] = {}
        known: dict[int, int] = {}
        docs, first, suspect, pairs = [], [], [], []
        for d, (text, label) in enumerate(rows):
            bag: set[int] = set()
            for part in plain(SENTENCE.sub("\n", text)).split("\n"):
                own = [index.setdefault(w, len(index)) for w in with_spelt(part.split())]
                bag.update(own)
                for i in range(0, len(own), WINDOW):
                    ids = tuple(own[i : i + WINDOW])
                    s = known.setdefault(hash(ids), len(known))
                    if s == len(first):
                        first.append(d)
                        suspect.append(bool(label))
                        pairs.append(np.fromiter({*ids}, np.int32))
                    suspect[s] &= bool(label)
            docs.append(np.sort(np.fromiter(bag, np.int32)))
        word = np.concatenate(pairs) if pairs else np.zeros(0, np.int32)
        return cls(list(index), np.array([int(y) for _, y in rows]), docs, np.repeat(np.arange(len(pairs)), [len(x) for x in pairs]), word, np.array(first, np.int64), np.array(suspect, bool))


@dataclass
class Trainer:
    """What all machines of one sample share: the spelling of its words and their runs of four characters."""

    bags: Bags
    cost: float

    def __post_init__(self) -> None:
        self.spelt = spell(self.bags.names)
        chars, starts, lengths = self.spelt
        parts = []
        for a in range(0, len(starts), 5_000):  # a run's word and its run come in order of the word
            word, key, _ = features(chars, starts[a : a + 5_000], lengths[a : a + 5_000], ((1, 2, 3),))
            parts.append(((word + a).astype(np.int32), key.astype(np.int32)))
        self.gram_word, key = (np.concatenate(x) for x in zip(*parts, strict=True))
        unique, inverse = np.unique(key, return_inverse=True)
        self.many, self.gram = len(unique), inverse.astype(np.int32)
        self.starts = np.append(0, np.cumsum(np.bincount(self.gram_word, minlength=len(self.bags.names))))[:-1]
        del parts, key, unique, inverse
        give_back()
        self.letters = "".join(sorted({c for w in self.bags.names for c in w if c.isalpha()}))[:200] or "x"

    def values(self, machine: Machine, which: np.ndarray) -> np.ndarray:
        """Of the words numbered `which`."""
        chars, starts, lengths = self.spelt
        return machine.words(chars, starts[which], lengths[which])

    def machine(self, used: np.ndarray, landmarks: int, negatives: int, rounds: int) -> tuple[Machine, list[str]] | None:
        """Learned from the documents flagged in `used`, with the words that tell by themselves."""
        b = self.bags
        own = used[b.first][b.sentence]
        dark = b.suspect[b.sentence]
        n1, n0 = int((b.suspect & used[b.first]).sum()), int((~b.suspect & used[b.first]).sum())
        if not n1 or not n0:
            return None
        c1 = np.bincount(b.word[own & dark], minlength=len(b.names))
        c0 = np.bincount(b.word[own & ~dark], minlength=len(b.names))
        alone = likelihood(c1, c0, n1, n0)
        dark_run, clean_run = (np.bincount(self.gram, c[self.gram_word], self.many) for c in (c1, c0))
        runs = likelihood(dark_run, clean_run, n1, n0)
        best = lambda worth: np.maximum.reduceat(worth[self.gram], self.starts)
        shared = best(runs)
        telling = np.maximum(alone, shared)
        rare = (c0 * n1 * 4 <= c1 * n0) & (self.spelt[2] > 1)  # single characters tell as the word they spell
        positive = {*np.flatnonzero((alone >= EVIDENCE) & rare).tolist(), *np.flatnonzero((shared >= EVIDENCE) & rare & (c1 > 0)).tolist()}
        rank = lambda ids: sorted(ids, key=lambda i: (-telling[i], -c1[i], b.names[i]))
        if not positive:  # a small sample: the words that come nearest
            positive = {*rank(np.flatnonzero((c1 > 0) & rare).tolist())[:landmarks // 4]}
        if not positive:
            return None
        # firm: words that no clean sentence has, neither whole nor in a telling run of theirs; others tell only in numbers
        pure = best((clean_run == 0) & (runs >= EVIDENCE))
        firm = [i for i in rank(positive) if alone[i] >= EVIDENCE and not c0[i] and pure[i]]
        margin = dict.fromkeys(firm, 1.0)
        ranked = [b.names[i] for i in rank(positive)]
        clean = np.flatnonzero(c0)
        common = [b.names[i] for i in clean[np.argsort(-c0[clean], kind="stable")][:negatives].tolist()]
        near = np.flatnonzero((c0 > 0) & (shared >= EVIDENCE / 2))  # clean words that share a run of characters with what tells
        marks_toxic = [*dict.fromkeys(ranked[:landmarks // 4] + apart(ranked[:1500], landmarks // 2))]
        marks, negative, machine = sorted({*marks_toxic, *common[:landmarks // 4]}), dict.fromkeys(common), None
        index = {b.names[i]: i for i in clean.tolist()}
        bent: dict[str, float] = {}
        for i in (i for i in firm if len(b.names[i]) > 3):
            some = [v for v in variants(b.names[i], self.letters) if v not in index]
            bent |= {v: max(bent.get(v, 0.0), 0.5 * c1[i] / len(some)) for v in some}
        bags = [d for d, y, u in zip(b.docs, b.labels.tolist(), used.tolist(), strict=True) if y and u and len(d)]
        for turn in range(rounds):
            pos, neg = sorted(positive), sorted(negative)
            more = sorted(bent)
            up = np.array([*(max(1.0, float(c1[i])) for i in pos), *(bent[v] for v in more)])
            machine = machine_of(marks, [b.names[i] for i in pos] + more, neg, np.array([*(margin.get(i, SOFT) for i in pos), *([1.0] * len(more))]), up, np.sqrt([float(c0[index[w]]) for w in neg]), self.cost)
            if turn == rounds - 1:
                break
            # a toxic document without a toxic word gives the one that comes nearest, if it is in no clean sentence
            for d in bags:
                if positive.isdisjoint(d.tolist()) and len(d := d[c0[d] == 0]):
                    value = self.values(machine, d)
                    if value.max() > -0.7:
                        positive.add(int(d[np.argmax(value)]))
            value = self.values(machine, near)
            hard = [b.names[i] for i in near[np.lexsort((near, -value))][:2000][np.sort(-value)[:2000] < 0.95].tolist()]
            negative |= dict.fromkeys(hard)
            marks = sorted({*marks_toxic, *common[:landmarks // 4], *apart(hard[:1000], landmarks // 4)})
        give_back()
        halves = [(w[:i], w[i:]) for w in (b.names[i] for i in firm[:2000]) for i in range(1, len(w))]
        machine.left, machine.right = (np.unique(hashes_of([h[k] for h in halves])) for k in (0, 1))
        return machine, [b.names[i] for i in firm]


def hashes_of(own: list[str]) -> np.ndarray:
    """The hash that `words` gives each of these words."""
    chars, offsets = code_points(own)
    return words(chars, offsets, _SPACE)[2]


def tops_of(owner: np.ndarray, value: np.ndarray, key: np.ndarray, many: int) -> np.ndarray:
    """The TOP highest values of each owner, in falling order; FLOOR where there are fewer. A key counts once an owner."""
    value = np.minimum(value, CEILING)
    keep = value > FLOOR
    owner, value, key = owner[keep], value[keep], key[keep]
    order = np.lexsort((key, -value, owner))
    owner, value, key = owner[order], value[order], key[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1]))[: len(owner)]
    owner, value = owner[new], value[new]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    out = np.full((many, TOP), FLOOR)
    keep = place < TOP
    out[owner[keep], place[keep]] = value[keep]
    return out


def train(rows: list[tuple[str, int]], landmarks: int = 240, negatives: int = 6_000, rounds: int = 2, cost: float = 200.0, parts: int = 4) -> Machine | None:
    """The machine for (text, label) rows; None without both labels or without a word that could tell them apart.

    Landmarks are toxic words that differ from each other, frequent clean words and, after a first machine, the clean words it finds
    most toxic; those also join the negative examples, which else are the most frequent clean words. As many more machines as `parts`,
    each learned from all other parts of the documents, score their own part; the logistic curve is fitted to these scores.
    """
    part = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % parts for t, _ in rows])
    bags = Bags.of(rows)
    del rows
    if not bags.names:
        return None
    trainer = Trainer(bags, cost)
    found = trainer.machine(np.ones(len(part), bool), landmarks, negatives, rounds)
    if found is None:
        return None
    machine, firm = found
    tops, told = np.full((len(part), TOP), FLOOR), np.zeros(len(part), bool)
    for k in range(parts):
        other = trainer.machine(part != k, landmarks, negatives, rounds)
        if other is None:
            continue
        own = np.flatnonzero(part == k)
        used = np.unique(np.concatenate([bags.docs[i] for i in own])) if len(own) else np.zeros(0, np.int64)
        value = np.zeros(len(bags.names))
        value[used] = trainer.values(other[0], used)
        word = np.concatenate([bags.docs[i] for i in own]) if len(own) else used
        tops[own] = tops_of(np.repeat(np.arange(len(own)), [len(bags.docs[i]) for i in own]), value[word], word, len(own))
        told[own] = True
    if len({*bags.labels[told].tolist()}) < 2:
        value, told = trainer.values(machine, np.arange(len(bags.names))), np.ones(len(part), bool)
        word = np.concatenate(bags.docs)
        tops = tops_of(np.repeat(np.arange(len(part)), [len(d) for d in bags.docs]), value[word], word, len(part))
    # a word that tells by itself is enough: each stands for a document of its own, as the machine sees it
    lone = np.full((len(firm), TOP), FLOOR)
    if firm:
        lone[:, 0] = np.clip(machine.words(*spell(firm)), FLOOR, CEILING)
    del trainer
    give_back()
    machine.weights, machine.shift = logistic(np.vstack([tops[told], lone]), np.append(bags.labels[told], np.ones(len(firm), np.int64)))
    return machine


def logistic(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights, none of them negative, and shift of the logistic curve through documents' values."""
    each = np.where(label == 1, ((1 - label).sum() / label.sum()) ** 0.35, 1.0)
    target = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    free = np.ones(x.shape[1], bool)
    while True:
        own = np.column_stack([x[:, free], np.ones(len(x))])
        w = np.zeros(own.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            ridge = np.append(np.full(own.shape[1] - 1, 0.02), 1e-4)
            step = np.linalg.solve((own * (each * p * (1 - p) + 1e-6)[:, None]).T @ own + np.diag(ridge), own.T @ (each * (p - target)) + ridge * w)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        if len(w) == 1 or w[:-1].min() >= 0:
            out = np.zeros(x.shape[1])
            out[free] = w[:-1]
            return out, float(w[-1])
        free[np.flatnonzero(free)[np.argmin(w[:-1])]] = False


class Scorer:
    """Scores texts; keeps the values of words it has met, at most about `limit` of them."""

    def __init__(self, machine: Machine | None, limit: int = 400_000) -> None:
        self.machine, self.limit = machine, limit
        self.hashes, self.known = np.zeros(0, np.uint64), np.zeros(0)

    def values(self, hashes: np.ndarray, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.hashes, unique)
        old = np.append(self.hashes, np.uint64(0))[spot] == unique
        old &= spot < len(self.hashes)
        out = np.zeros(len(unique))
        out[old] = self.known[spot[old]]
        new = first[~old]
        out[~old] = self.machine.words(chars, starts[new], lengths[new])
        if len(self.hashes) > self.limit:
            self.hashes, self.known = unique, out
        else:
            both, value = np.append(self.hashes, unique[~old]), np.append(self.known, out[~old])
            order = np.argsort(both, kind="stable")
            self.hashes, self.known = both[order], value[order]
        return out[which]

    def scores(self, texts: list[str]) -> np.ndarray:
        """The toxicity of each whole text; 0 without a machine, the value of no toxic word for a text without words."""
        if self.machine is None:
            return np.zeros(len(texts))
        chars, offsets = code_points([t.lower() for t in texts])
        kept = _KEPT[np.minimum(chars, 0x3000)]
        chars, offsets = chars[kept], np.append(0, np.cumsum(kept))[offsets]
        starts, lengths, hashes, bounds = words(chars, offsets, _SPACE)
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        found = [(owner, self.values(hashes, chars, starts, lengths), hashes)]
        if len(starts):
            text, own, at, many = spelt(chars, starts, lengths, bounds)
            found.append((text, self.machine.words(own, at, many), np.array([hash(own[a : a + n].tobytes()) for a, n in zip(at.tolist(), many.tolist(), strict=True)], np.int64).view(np.uint64)))
            # words cut in two: where both halves of a learned word stand side by side, what they spell is scored as one word
            pair = np.flatnonzero(np.isin(hashes[:-1], self.machine.left) & np.isin(hashes[1:], self.machine.right) & (owner[1:] == owner[:-1]))
            joined = ["".join(map(chr, np.append(chars[starts[i] : starts[i] + lengths[i]], chars[starts[i + 1] : starts[i + 1] + lengths[i + 1]]).tolist())) for i in pair.tolist()]
            found.append((owner[pair], self.machine.words(*spell(joined)), hashes_of(joined)))
        return self.machine.probability(tops_of(*(np.concatenate(x) for x in zip(*found, strict=True)), len(texts)))


def scores(texts: list[str], machine: Machine | None) -> np.ndarray:
    return Scorer(machine).scores(texts)


def examples(docs: DataFrame, labels: DataFrame, toxic: int = 1200, clean: int = 3000) -> list[tuple[str, int]]:
    """A bounded training sample: the `toxic` and `clean` distinct texts of either label with the least text hash, each whole, as its label is for all of it.

    Held-out rows, null texts and labels other than 0 and 1 are never read; a text labelled more than once, itself or in a copy,
    counts as toxic if any label says so.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    pool = docs.where(~held_out() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
    both = pool.join(marked, "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    first = [both.where(F.col("toxic") == label).orderBy("h").limit(n) for label, n in ((1, toxic), (0, clean))]
    chosen = first[0].unionByName(first[1])
    # at most toxic + clean ids: a broadcast of bounded size; an id may also stand for other texts
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    found = texts.join(F.broadcast(chosen), ["doc_id", "h"]).select("h", "text", "toxic").distinct()
    return sorted((r["text"], r["toxic"]) for r in found.collect())


def predict(docs: DataFrame, machine: Machine | None, threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    A null or empty text scores as a text without a toxic word; without a machine (no labels) all score 0; repeated rows
    score alike; a null doc_id counts as not held out; an empty table gives no rows; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            ids, held, texts = column(batch, "doc_id"), column(batch, "held_out"), column(batch, "text")
            for a, b in slices(texts):
                s = scorer.scores([t or "" for t in texts.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), held.slice(a, b - a), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return texts_of(docs).select(docs["doc_id"].cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(trimmed(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, machine: Machine | None, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            texts = column(batch, "text")
            for a, b in slices(texts):
                s = scorer.scores([t or "" for t in texts.slice(a, b - a).to_pylist()])
                yield batch.slice(a, b - a).filter(pa.array(s < threshold, pa.bool_()))

    return texts_of(docs).mapInArrow(trimmed(run), docs.schema)
