"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel.

The kernel of two terms sums, over all strings of ``LENGTH`` letters that both hold as subsequences, a decay to the power of
the stretches that they span, and is normalised to one for equal terms: letters that are inserted, left out or set apart
lower it but don't end it. Terms are compared with a few landmarks only (Nyström): a sentence's feature for a landmark is
the kernel of its nearest term. A linear machine (squared hinge, Newton steps) is trained on labelled sentences in whitened
landmark coordinates; sentences of a toxic document carry its label if they score as toxic or are its worst (multiple
instances). Toxic documents are learned from once more with the words near to a landmark spoilt, by inserted or doubled letters,
so that such words count too. A document's score is a logistic function of its worst sentence, of all its sentences, and of
these by its length.

The model is fitted in one task from at most ``PER_CLASS`` labelled documents of each class, chosen by a hash of their
ids; every text is scored whole.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from math import comb, exp, lgamma, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_by_worker, slices, texts_of, unused_name

#: Subsequence length and decay; kernel values below FLOOR count as none; the others are taken to POWER.
LENGTH, DECAY, FLOOR, POWER = 4, 0.7, 0.3, 2
#: Landmarks of the Nyström map at most; labelled documents of each class that the model is fitted on at most.
LANDMARKS, PER_CLASS = 48, 700
#: Kernel from which a term counts as of a landmark's family; chance, over all candidates, that a family is toxic by accident.
NEAR, CHANCE = 0.5, 0.01
#: Of a landmark, the part of its gain that those taken before have to leave.
APART = 0.2
#: Part of the toxic documents that hold a candidate, two of them at least.
RARE = 0.005
#: Letters of the shortest stem, with the mark of a word's start.
STEM = 5
#: Longest stretch of a token that is one term; longer tokens are cut with half of it overlapping.
SPAN = 24
#: Landmarks that a step of the recursion takes together; terms at a time, and numbers of terms and landmarks, which bounds memory.
TOGETHER, AT_ONCE, CELLS = 12, 16384, 1 << 21
#: Score from which a document is called toxic.
REJECT = 0.7
#: Terms that a worker remembers.
REMEMBERED = 400_000
#: Letters that are put into words to spoil them.
INSERTED = "xzqkvjwh"
#: Single letters set apart.
SPACED = re.compile(r"(?<!\S)\w(?:[ *_-]{1,3}\w){3,}(?!\S)")


def coded(terms: list[str], width: int, pad: int) -> np.ndarray:
    """Code points of terms, padded."""
    out = np.full((len(terms), width), pad, np.int32)
    sizes = np.fromiter(map(len, terms), np.int64, len(terms))
    out[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(terms).encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def own_kernel(terms: list[str]) -> np.ndarray:
    """Kernel of each term with itself: ``inner[k]`` sums over pairs of equal subsequences of k + 1 letters, the second before a place."""
    out = np.zeros(len(terms), np.float32)
    sizes = np.fromiter(map(len, terms), np.int64, len(terms))
    for n in np.unique(sizes[sizes >= LENGTH]).tolist():
        own = np.flatnonzero(sizes == n)
        s = coded([terms[k] for k in own], n, 0)
        fall = np.triu(DECAY ** (np.arange(n) - np.arange(n)[:, None] + 1.0), 1)
        inner = np.zeros((LENGTH - 1, len(own), n))
        for a in range(n):
            match = s[:, a : a + 1] == s
            out[own] += DECAY**2 * (inner[-1] * match).sum(1)
            ended = np.concatenate([match[None], inner[:-1] * match]) @ fall
            inner = DECAY * inner + ended
    return out


@lru_cache(maxsize=SPAN + 3)
def least_own(n: int) -> float:
    """A lower bound of the own kernel of n letters: that of letters that all differ."""
    return sum((n - k + 1) * comb(k - 2, LENGTH - 2) * DECAY ** (2 * k) for k in range(LENGTH, n + 1))


def terms_of(token: str) -> list[str]:
    """What a token is compared as: itself without outer punctuation, and without inner punctuation if it has any; long ones in stretches."""
    if LENGTH - 2 <= len(token) <= SPAN - 2 and token.isalnum():
        return [f"^{token}$"]
    bare = token.strip("_").strip()
    while bare and not bare[0].isalnum():
        bare = bare[1:]
    while bare and not bare[-1].isalnum():
        bare = bare[:-1]
    found = [bare] if bare.isalnum() else [bare, "".join(c for c in bare if c.isalnum())]
    marked = [m for x in found if x and len(m := f"^{x}$") >= LENGTH]  # a word's start and end are letters too
    return [x[i : i + SPAN] for x in marked for i in range(0, max(1, len(x) - SPAN // 2), SPAN // 2)]


def sentences_of(text: str) -> list[list[str]]:
    """Tokens of each sentence in lower case; letters that are set apart form a token besides."""
    out = []
    for line in text.lower().split("\n"):
        if spaced := apart_in(line):
            out.append(spaced)
        own: list[str] = []
        for token in line.split():
            own.append(token)
            if token[-1] in ".!?":
                out.append(own)
                own = []
        if own:
            out.append(own)
    return out


def apart_in(text: str) -> list[str]:
    return ["".join(c for c in m if c.isalnum()) for m in SPACED.findall(text)]


class Block:
    """The recursion over gap-weighted subsequences for some landmarks, whose places are laid out in one row.

    For a term's letters read so far, ``inner[k]`` holds for each place the sum over common subsequences of k + 1 letters that
    lie before it, decayed up to both ends. Terms come sorted, and those that start alike share the steps of their start.
    """

    def __init__(self, landmarks: list[list[int]], letters: int):
        sizes = [len(x) for x in landmarks]
        owner, place = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])
        gap = place - place[:, None]
        fall = np.where((owner == owner[:, None]) & (gap > 0), DECAY ** (np.maximum(gap, 0) + 1.0), 0).astype(np.float32)
        whose = (DECAY**2 * (owner[:, None] == np.arange(len(sizes)))).astype(np.float32)
        self.width, self.n = len(owner), len(sizes)
        self.at = [np.flatnonzero(np.concatenate(landmarks) == c) for c in range(letters + 1)]
        self.fall, self.whose = [fall[at] for at in self.at], [whose[at] for at in self.at]

    def kernels(self, s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of rows of letters' numbers: 0 is one that no landmark holds."""
        out = np.zeros((len(s), self.n), np.float32)
        rows, node = np.arange(len(s)), np.zeros(len(s), np.int64)
        inner, total = np.zeros((LENGTH - 1, 1, self.width), np.float32), np.zeros((1, self.n), np.float32)
        for depth in range(s.shape[1]):
            letter = s[rows, depth]
            first = np.ones(len(rows), bool)
            first[1:] = (letter[1:] != letter[:-1]) | (node[1:] != node[:-1])
            by_letter = np.argsort(letter[first], kind="stable")
            parent, letters = node[first][by_letter], letter[first][by_letter]
            number = np.empty(len(parent), np.int64)
            number[by_letter] = np.arange(len(parent))
            node = number[np.cumsum(first) - 1]
            # starts that no term goes on from need their kernel only
            goes_on = sizes[rows] > depth + 1
            more = np.zeros(len(parent), bool)
            more[node[goes_on]] = True
            slot = np.concatenate([[0], np.cumsum(more)])
            kept = parent[more]
            before, inner = inner, inner[:, kept]
            inner *= np.float32(DECAY)
            total = total[parent]
            cuts = [0, *(np.flatnonzero(np.diff(letters)) + 1).tolist(), len(letters)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                at, fall = self.at[letters[i]], self.fall[letters[i]]
                if letters[i] and len(at):
                    total[i:j] += before[-1][parent[i:j, None], at] @ self.whose[letters[i]]
                    if (a := slot[i]) < (b := slot[j]):
                        inner[0, a:b] += fall.sum(0)
                        for k in range(1, LENGTH - 1):
                            inner[k, a:b] += before[k - 1][kept[a:b, None], at] @ fall
            out[rows[~goes_on]] = total[node[~goes_on]]
            rows, node, total = rows[goes_on], slot[node[goes_on]], total[more]
            if not len(rows):
                break
        return out


class Kernel:
    """Kernels of tokens with the landmarks; those of one token's terms are joined by their maximum."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.letters = frozenset(c for x in landmarks for c in x)
        self.points = np.array(sorted(map(ord, self.letters)), np.int32)
        self.scale = 1 / np.sqrt(np.maximum(own_kernel(landmarks), 1e-12))
        numbers = [self.numbers(coded([x], len(x), -1))[0] for x in landmarks]
        self.blocks = [Block(numbers[k : k + TOGETHER], len(self.points)) for k in range(0, len(numbers), TOGETHER)]
        self.held = np.zeros((len(self.points) + 1, len(landmarks)), np.int64)
        for k, x in enumerate(numbers):
            np.add.at(self.held[:, k], x, 1)
        self.zero = np.zeros(len(landmarks), np.float32)
        #: tokens and terms that some landmark is near to, and those that none is
        self.known: dict[str, np.ndarray] = {}
        self.terms: dict[str, np.ndarray] = {}
        self.far: set[str] = set()
        self.far_terms: set[str] = set()

    def numbers(self, points: np.ndarray) -> np.ndarray:
        """A number for each letter, from code points; 0 is a letter that no landmark holds."""
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at + 1, 0)

    def may_reach(self, s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether a term's kernel with a landmark may reach FLOOR, by a bound on its size.

        Common subsequences use only letters that both hold. Of a term's c such letters, the sum of squares of its
        subsequences is ``least_own(c)`` at most where all differ, and grows by a factor of the ways to spell one at most.
        """
        held = np.zeros((len(s), len(self.held)), np.int64)
        row, at = np.nonzero(s)
        np.add.at(held, (row, s[row, at]), 1)
        longest = max(s.shape[1], *map(len, self.landmarks))
        least = np.array([least_own(n) for n in range(longest + 1)], np.float32)
        ways = np.array([log(comb(n, n // 2)) for n in range(longest + 1)], np.float32)
        theirs, ours = (self.held > 0).astype(np.float32), (held > 0).astype(np.float32)
        bound = least[np.rint(held.astype(np.float32) @ theirs).astype(int)] * least[np.rint(ours @ self.held.astype(np.float32)).astype(int)]
        bound *= np.exp(ways[held] @ theirs + ours @ ways[self.held]) * self.scale**2
        return bound >= (FLOOR * 0.999) ** 2 * least[sizes][:, None]

    def of_terms(self, terms: list[str]) -> np.ndarray:
        out = np.zeros((len(terms), len(self.landmarks)), np.float32)
        order = sorted((k for k, x in enumerate(terms) if len(x) >= LENGTH), key=terms.__getitem__) if self.blocks else []
        together = max(64, min(AT_ONCE, CELLS // max(1, len(self.landmarks))))
        for start in range(0, len(order), together):
            at = np.array(order[start : start + together])
            own = [terms[k] for k in at]
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            s = self.numbers(coded(own, int(sizes.max()), -1))
            near = self.may_reach(s, sizes)
            value = np.zeros((len(own), len(self.landmarks)), np.float32)
            for k, block in enumerate(self.blocks):
                part = slice(k * TOGETHER, k * TOGETHER + block.n)
                if len(rows := np.flatnonzero(near[:, part].any(1))):
                    value[rows, part] = block.kernels(s[rows], sizes[rows])
            value *= self.scale
            close = np.flatnonzero(value.max(1) >= FLOOR * np.sqrt([least_own(n) for n in sizes.tolist()]))
            out[at[close]] = value[close] / np.sqrt(own_kernel([own[k] for k in close]))[:, None]
        out[out < FLOOR] = 0
        return out**POWER  # a power of a kernel is a kernel

    def learn(self, tokens: Iterable[str]) -> None:
        """Puts what some landmark is near to in ``known``."""
        new = set(tokens)
        new -= self.far
        new -= self.known.keys()
        if len(self.far) > REMEMBERED:
            self.far.clear()
        if len(self.known) > REMEMBERED:
            self.known.clear()
            new = set(tokens)
        split = {x: terms_of(x) for x in new}
        if len(self.far_terms) + len(self.terms) > REMEMBERED:
            self.far_terms.clear()
            self.terms.clear()
        fresh = {x for parts in split.values() for x in parts}
        fresh -= self.far_terms
        fresh -= self.terms.keys()
        if fresh and self.landmarks:
            order = list(fresh)
            values = self.of_terms(order)
            for k in np.flatnonzero(values.any(1)).tolist():
                self.terms[order[k]] = values[k].copy()
        self.far_terms |= fresh - self.terms.keys()
        near = self.terms
        for token, parts in split.items():
            if found := [near[x] for x in parts if x in near]:
                self.known[token] = np.maximum.reduce(found)
            else:
                self.far.add(token)


class Model:
    """Landmarks, a sentence's weights and bias, and the logistic curve over a document's evidence."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, curve: np.ndarray):
        self.landmarks, self.weights, self.bias, self.curve = landmarks, weights, bias, curve

    def chance(self, evidence: tuple[float, float, float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.curve[:-1], evidence) + self.curve[-1], -30, 30))))


def evidence_of(margins: list[float], n_tokens: int) -> tuple[float, float, float]:
    """Of a document: its worst sentence, all sentences together, and these by length; margins are above a sentence without near terms."""
    over = [m for m in margins if m > 0]
    return max(over, default=0.0), float(np.log1p(sum(over))), sum(over) / (1 + n_tokens / 200)


class Scorer:
    """Scores whole texts with a model."""

    def __init__(self, model: Model):
        self.model, self.kernel = model, Kernel(model.landmarks)

    def scores(self, texts: list[str]) -> list[float]:
        split = [t.lower().split() for t in texts]
        spaced = [apart_in(t.lower()) for t in texts]
        self.kernel.learn({*chain.from_iterable(split), *chain.from_iterable(spaced)})
        known, model = self.kernel.known, self.model
        none = model.chance((0.0, 0.0, 0.0))
        out = []
        for text, tokens, apart in zip(texts, split, spaced, strict=True):
            if known.keys().isdisjoint(tokens) and known.keys().isdisjoint(apart):
                out.append(none)
                continue
            margins = [float(np.maximum.reduce(found) @ model.weights) for s in sentences_of(text) if (found := [known[w] for w in s if w in known])]
            out.append(model.chance(evidence_of(margins, len(tokens))))
        return out


def spoilt(token: str, way: int) -> str:
    """The token as someone would write it to get past a list: a letter or two put in, or letters doubled. Which and where depends on the token alone."""
    if len(token) < 4:
        return token
    h = crc32(token.encode("utf-8", "surrogatepass")) + way
    at, letter = 1 + h % (len(token) - 2), INSERTED[h // 7 % len(INSERTED)]
    if way % 4 == 0:
        return token[:at] + letter + token[at:]
    if way % 4 == 1:
        other = 1 + (at + len(token) // 2) % (len(token) - 1)
        low, high = sorted((at, other))
        return token[:low] + letter + token[low:high] + letter + token[high:]
    return "".join(c * 2 for c in token) if way % 4 == 2 else token[:at] + token[at] + token[at:]


def with_spoilt(docs: list[list[list[str]]], y: np.ndarray, kernel: Kernel) -> list[list[list[str]]]:
    """The toxic documents once more, the words that are near to a landmark spoilt."""
    near, out = NEAR**POWER, []
    for k, (d, bad) in enumerate(zip(docs, y, strict=True)):
        if bad:
            hot = {w for s in d for w in s if w in kernel.known and kernel.known[w].max() >= near}
            if hot:
                out.append([[spoilt(w, k) if w in hot else w for w in s] for s in d])
    return out


def fit(texts: list[str], toxic: list[int]) -> Model:
    """A model from labelled documents. Without both classes, or without any telling term, every text scores 0."""
    docs = [sentences_of(t) for t in texts]
    y = np.array(toxic, bool)
    blank = Model([], np.zeros(0, np.float32), 0.0, np.array([0, 0, 0, -30.0]))
    if y.all() or not y.any():
        return blank
    landmarks = choose_landmarks(docs, y)
    if not landmarks:
        return blank
    kernel = Kernel(landmarks)
    kernel.learn({w for d in docs for s in d for w in s})
    more = with_spoilt(docs, y, kernel)
    kernel.learn({w for d in more for s in d for w in s})
    docs, y = docs + more, np.append(y, np.ones(len(more), bool))
    rows, owner = [], []
    for k, d in enumerate(docs):
        held = {}
        for s in d:
            found = [kernel.known[w] for w in s if w in kernel.known]
            z = np.maximum.reduce(found) if found else kernel.zero
            held[z.tobytes()] = z  # equal sentences of a document count once
        rows += list(held.values()) or [kernel.zero]
        owner += [k] * (len(held) or 1)
    z, owner = np.array(rows, np.float64), np.array(owner)
    # whitening by the landmarks' own kernel matrix
    own = kernel.of_terms(landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2 + 1e-3 * np.eye(len(own)))
    white = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    x = z @ white
    bad = y[owner]
    label = np.where(bad & (z.sum(1) > 0), 1.0, -1.0)
    for _ in range(4):
        w, b = squared_hinge(x, label)
        f = x @ w + b
        best = np.full(len(docs), -np.inf)
        np.maximum.at(best, owner, f)
        label = np.where(bad & ((f > 0) | (f == best[owner])), 1.0, -1.0)
    weights = (white @ w).astype(np.float32)
    evidence = []
    for d in docs:
        margins = [float(np.maximum.reduce(found) @ weights) for s in d if (found := [kernel.known[t] for t in s if t in kernel.known])]
        evidence.append(evidence_of(margins, sum(map(len, d))))
    return Model(landmarks, weights, float(b), logistic(np.array(evidence), y))


def stems_of(terms: Iterable[str]) -> set[str]:
    """Starts of terms, from STEM letters on, the mark of a word's start included: a stem stands for all words that it begins."""
    return {t[:k] for t in terms if t[0] == "^" for k in range(STEM, len(t))}


def choose_landmarks(docs: list[list[list[str]]], y: np.ndarray) -> list[str]:
    """Terms and stems whose families (terms near by the kernel) stand in toxic documents more often than chance explains.

    Stems are candidates if toxic documents hold them, as they are, more often than chance explains; terms, if a few toxic
    documents hold them, clean ones much more seldom, and terms near by make up for what is missing, at least when only the
    term itself is looked for in clean documents. All terms of clean documents then decide. Landmarks are taken by gain, near
    ones of those taken counting less.
    """
    of_doc = [{x for s in d for w in s for x in terms_of(w)} for d in docs]
    n_bad, n_good = int(y.sum()), int((~y).sum())
    clean, dirty, good_stems, bad_stems = Counter(), Counter(), Counter(), Counter()
    for d, bad in zip(of_doc, y, strict=True):
        (dirty if bad else clean).update(d)
        (bad_stems if bad else good_stems).update(stems_of(d))
    few = max(2, RARE * n_bad)
    terms = sorted(t for t in dirty if dirty[t] >= few and dirty[t] * n_good >= 5 * n_bad * clean[t])
    stems = sorted(t for t in bad_stems if bad_stems[t] >= few)
    tried = len(terms) + len(stems)
    support = family_support(terms, of_doc, y)
    whole = {t: n / n_bad for t, n in zip(terms, support, strict=True) if is_telling(n, clean[t], n_bad, n_good, tried)}
    starts = {t: bad_stems[t] / n_bad - good_stems[t] / n_good for t in stems if is_telling(bad_stems[t], good_stems[t], n_bad, n_good, tried)}
    own = [t for part in (whole, starts) for t in set_apart(list(part), np.array(list(part.values())))]
    if not own:
        return []
    kernel, counts = Kernel(own), np.zeros((2, len(own)))
    every = list(clean.keys() | dirty.keys())
    families: dict[str, list[int]] = {}
    for start in range(0, len(every), 4096):
        part = every[start : start + 4096]
        for k, m in zip(*np.nonzero(kernel.of_terms(part) >= NEAR**POWER), strict=True):
            families.setdefault(part[k], []).append(int(m))
    for d, bad in zip(of_doc, y, strict=True):
        if held := {m for t in d if t in families for m in families[t]}:
            counts[int(bad), list(held)] += 1
    gain = counts[1] / n_bad - 3 * counts[0] / n_good
    keep = [k for k in range(len(own)) if gain[k] > 0 and is_telling(counts[1, k], counts[0, k], n_bad, n_good, tried)]
    return set_apart([own[k] for k in keep], gain[keep])[:LANDMARKS]


def set_apart(own: list[str], gain: np.ndarray) -> list[str]:
    """Candidates by what those taken before leave of their gain, as long as that is APART of it at least."""
    chosen: list[str] = []
    if own:
        alike, left = np.minimum(1, Kernel(own).of_terms(own)), np.ones(len(own))
        while (gain * left).max() > 0:
            k = int((gain * left).argmax())
            chosen.append(own[k])
            left *= 1 - alike[:, k]
            left[left < APART] = 0
            left[k] = 0
    return chosen


def family_support(own: list[str], of_doc: list[set[str]], y: np.ndarray) -> np.ndarray:
    """In how many toxic documents a candidate near to each candidate stands."""
    support = np.zeros(len(own))
    if not own:
        return support
    place, held = {t: k for k, t in enumerate(own)}, [[] for _ in own]
    for number, (d, bad) in enumerate(zip(of_doc, y, strict=True)):
        if bad:
            for t in d:
                if t in place:
                    held[place[t]].append(number)
    for start in range(0, len(own), 256):
        near = Kernel(own[start : start + 256]).of_terms(own) >= NEAR**POWER
        for k in range(near.shape[1]):
            support[start + k] = len({n for t in np.flatnonzero(near[:, k]).tolist() for n in held[t]})
    return support


def is_telling(bad: float, good: float, n_bad: int, n_good: int, tried: int) -> bool:
    """Whether so many toxic of all documents that hold a family are more than chance gives in ``tried`` families: a binomial tail."""
    bad, n, share = int(bad), int(bad + good), n_bad / (n_bad + n_good)
    if not bad or bad <= n * share:
        return False
    tail = sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(share) + (n - k) * log(1 - share)) for k in range(bad, n + 1))
    return tail * tried < CHANCE


def squared_hinge(x: np.ndarray, y: np.ndarray, c: float = 40.0) -> tuple[np.ndarray, float]:
    """Linear machine by Newton steps; both classes weigh the same."""
    n, m = x.shape
    a = np.hstack([x, np.ones((n, 1))])
    cost = np.where(y > 0, c / max(1, (y > 0).sum()), c / max(1, (y < 0).sum())) * 100
    w = np.zeros(m + 1)
    ridge = np.eye(m + 1)
    ridge[m, m] = 1e-6
    for _ in range(30):
        active = y * (a @ w) < 1
        h = ridge + (a[active] * cost[active, None]).T @ a[active]
        new = np.linalg.solve(h, a[active].T @ (cost[active] * y[active]))
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w[:m], float(w[m])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes and level of a logistic curve through documents' evidence, with softened targets (Platt); a clean document called toxic costs twice as much as the reverse."""
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    weight = np.where(y, 50 / max(1, y.sum()), 100 / max(1, (~y).sum()))
    spread = x.std(0) + 1e-9
    a = np.hstack([x / spread, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([0.02] * x.shape[1] + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - target)) + ridge @ w
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return np.append(w[:-1] / spread, w[-1])


def held_out(id_col: str = "doc_id"):
    """Rows that no label is learned from: CRC-32 of the id as text leaves 1 modulo 3. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``id``, ``text``, ``y``: PER_CLASS rows of each class at most, in the order of a hash, none of them held out. An id with both labels counts as toxic."""
    usable = labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    order = F.xxhash64(F.col("id").cast("string"))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    parts = []
    for value in (0, 1):
        ids = F.broadcast(usable.filter(F.col("y") == value).orderBy(order, "id").limit(PER_CLASS))  # PER_CLASS ids at most
        rows = texts.join(ids, F.col("doc") == F.col("id")).select("id", "text", "y")
        parts.append(rows.orderBy(order, "id", F.xxhash64("text"), "text").limit(PER_CLASS))  # ids may have several rows
    return parts[0].union(parts[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits in one task, on labelled_sample(); only the model, some kilobytes, comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]  # 2 * PER_CLASS at most
        rows.sort(key=lambda r: (str(r["id"]), r["y"], r["text"] or ""))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r["text"] or "" for r in rows], [r["y"] for r in rows]))], pa.binary())], ["model"])

    sample = labelled_sample(docs, labels, id_col, text_col, label_col)
    made = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(bytes(made["model"])) if made else fit([], [])


def scorer_of(model: bytes) -> Scorer:
    """The worker process's, with what it remembers."""
    return held_by_worker(("toxicity", model), lambda: Scorer(pickle.loads(model)))


def with_score(docs: DataFrame, model: Model, score_col: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a further column; null and empty texts score as texts without any near term."""
    packed, text, rows = pickle.dumps(model), text_col, docs
    if docs.schema[text_col].dataType != T.StringType():
        rows = docs.withColumn(text := unused_name(docs, "text"), F.col(text_col).cast("string"))
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(packed)
        for batch in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scorer.scores(texts_of(batch.column(text))), pa.float64())], [*kept, score_col])

    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score``, for each row; null ids and repeated rows are kept, other columns play no part."""
    own = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return with_score(own, model, "score", "_text").select(id_col, "score")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that score under REJECT, as they are: each row is judged by its own text, whatever its id."""
    name = unused_name(docs, "score")
    return with_score(docs, model, name, text_col).filter(F.col(name) < REJECT).drop(name)
