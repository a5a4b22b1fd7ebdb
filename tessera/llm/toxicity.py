"""Toxicity: a support vector machine on a gapped subsequence string kernel with Nystroem landmarks.

Kernel of words: common subsequences of `ORDER` letters, each occurrence weighted DECAY ** span, normalised to 1 for
equal words and raised to `POWER` (a kernel again). Characters that aren't letters match nothing; a run of them widens
spans by one, however long it is, so `i.d.i.o.t` and `i----d----i----o----t` are equally near `idiot`; letters spelled
apart ("i d i o t") are read as one word. Words of up to `LONGEST` places have their letter triples listed, longer
ones summed by a recursion (`triple_sums`); both give the same sums, nothing is cut or left out.

Kernel of a sentence with a landmark word: the best over the sentence's words, each word's row of kernel values being
exact. Landmarks are words, sentences of one word, so the features K_mm ** -1/2 k(landmarks, sentence) and K_mm come from
one kernel. They feed a linear SVM, trained as a multiple-instance problem: labels belong to documents, all sentences of
clean documents are negative, and the witness sentence of each toxic document is chosen anew by the current machine;
each toxic document is learned from once more with a letter inserted into each longer word. A letter that alone stands
at every second place of a word is filler, like a gap. A document scores by its worst sentence, calibrated to a probability.

The training texts are at most `MAX_TRAIN` labelled rows a class, landmarks at most `LANDMARKS`; everything else covers
all documents.

Defined cases: a null or empty text has no sentence and scores as an all-zero sentence; null labels and
ids are not learned from; without both classes every score is the positives' share (0 without rows);
of the rows of a repeated id the one of the smallest text is learned from; repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, text_of, text_udf

ORDER = 3
DECAY = 0.9
POWER = 3
#: Places up to which a word's letter triples are listed.
LONGEST = 24
LANDMARKS = 96
#: A word may be a toxic landmark if in this share of the toxic training texts, and so many times likelier there.
MIN_SHARE, MIN_ODDS = 0.005, 6
MAX_TRAIN = 1200
#: Ridge of the SVM; kernel value from which a clean word is confusable with a toxic landmark; weight of witnesses with inserted letters.
REG, CONFUSED, INSERTED = 1e-3, 0.2, 0.3
ALPHABET = 64
#: Words whose number a worker remembers.
REMEMBER = 500_000
#: Characters from which texts are parsed in parts.
CHARS = 4_000_000
#: Products of a word's triple with a landmark's held at once.
AT_ONCE = 1_000_000

_SENTENCE = re.compile(r"[.!?]+\s+|\n+")
_SINGLES = re.compile(r"\s\S[\x20\t]\S[\x20\t]\S(?!\S)")
_GAP = re.compile(b"\0+")
_SPELLED = re.compile(r"(?<!\S)(?:\S[\x20\t]){2,}\S(?!\S)")


def _code(c: str) -> int:
    """1-26 for a-z, 27-63 by code point for other letters, 0 for what isn't a letter."""
    return 0 if not c.isalpha() else ord(c) & 31 if c.isascii() else 27 + ord(c.lower()[0]) % 37


_LATIN = bytes(_code(chr(c)) for c in range(256))
#: The same with a mark for the line ends between joined words.
_LINES = bytes(0xFF if c == 10 else _LATIN[c] for c in range(256))


def codes(word: str) -> bytes:
    """The codes of a word's characters, each gap one place wide, none at the ends."""
    return _closed(word.encode("latin-1").translate(_LATIN) if word.isascii() or max(word) <= "\xff" else bytes(map(_code, word)))


def all_codes(words: list[str]) -> list[bytes]:
    """`codes` of each word, looked up for all at once; words hold no white space."""
    runs = "\n".join(words).encode("latin-1", "replace").translate(_LINES).split(b"\xff")
    return [_closed(c) if w.isascii() or max(w) <= "\xff" else codes(w) for w, c in zip(words, runs)]


def _closed(c: bytes) -> bytes:
    """Codes without gaps at the ends, with filler as gaps and each gap one place wide."""
    c = c.strip(b"\0")
    if len(c) >= 9 and c[1] == c[3] and c[1] not in c[::2] and c[1::2] == c[1:2] * (len(c) // 2):
        c = c.replace(c[1:2], b"\0")  # filler: one letter at every second place
    return _GAP.sub(b"\0", c) if b"\0" in c else c


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence; letters spelled apart are joined by gaps."""
    spelled = _SPELLED.sub(lambda m: m[0].replace(" ", "-").replace("\t", "-"), text) if _SINGLES.search(" " + text) else text
    return [words for part in _SENTENCE.split(spelled) if (words := part.split())]


_PLACES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All position triples within a word of n places and their weights."""
    if n not in _PLACES:
        at = np.array(list(combinations(range(n), ORDER)), dtype=np.int64).reshape(-1, ORDER)
        _PLACES[n] = at, (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)
    return _PLACES[n]


def _triples(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of the triples of equally long words; where a place isn't a letter, the code has a digit 0."""
    at, weight = _places(group.shape[1])
    a, b, c = (group.astype(np.int32)[:, at[:, k]] for k in range(3))
    return (a * ALPHABET + b) * ALPHABET + c, weight


def _by_length(words: list[bytes]):
    """(places in the list, code matrix) of the words of each length from ORDER to LONGEST."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    for n in np.unique(lengths[(lengths >= ORDER) & (lengths <= LONGEST)]):
        at = np.flatnonzero(lengths == n)
        for part in np.array_split(at, max(1, len(at) * len(_places(int(n))[1]) // 100_000)):
            yield part, np.frombuffer(b"".join(words[k] for k in part), dtype=np.uint8).reshape(len(part), int(n))


def _aged(x: np.ndarray) -> np.ndarray:
    """For each place of the first axis, what stands before it, aged by the distance."""
    out = np.zeros_like(x)
    for k in range(1, len(x)):
        np.add(out[k - 1], x[k - 1], out=out[k])
        out[k] *= DECAY
    return out


def _norms(group: np.ndarray) -> np.ndarray:
    """Root of the kernel of each word with itself: pairs of equal letters, continued by ORDER - 1 further such pairs."""
    g = np.ascontiguousarray(group.T)
    same = ((g[:, None] == g) & (g > 0)).astype(np.float32)
    ends = same
    for _ in range(ORDER - 1):
        ends = same * _aged(_aged(ends).swapaxes(0, 1)).swapaxes(0, 1)
    return DECAY * np.sqrt(ends.sum(axis=(0, 1)))


def triple_sums(word: bytes) -> np.ndarray:
    """Summed weights of a word's letter triples, by code, in time linear in its length."""
    one, two, three = np.zeros(ALPHABET), np.zeros((ALPHABET, ALPHABET)), np.zeros((ALPHABET, ALPHABET, ALPHABET))
    for x in word:  # what is there ages by a place, then the letter ends, continues and starts subsequences
        one *= DECAY
        two *= DECAY
        if x:
            three[:, :, x] += two
            two[:, x] += one
            one[x] += DECAY
    return three.ravel()


class Kernel:
    """Normalised kernel values of words with fixed landmarks."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks = landmarks
        sums: list[dict[int, float]] = []
        for word in landmarks:
            code, weight = _triples(np.frombuffer(word, dtype=np.uint8)[None, :])
            own: dict[int, float] = {}
            for c, w in zip(code[0].tolist(), weight.tolist()):
                if c % ALPHABET and c // ALPHABET % ALPHABET and c // ALPHABET**2:
                    own[c] = own.get(c, 0.0) + w
            norm = math.sqrt(sum(v * v for v in own.values())) or 1.0
            sums.append({c: v / norm for c, v in own.items()})
        used = sorted({c for s in sums for c in s})
        self.row = np.zeros(ALPHABET**3, dtype=np.int32)
        self.row[used] = np.arange(1, len(used) + 1)
        self.values = np.zeros((len(used) + 1, len(landmarks)), dtype=np.float32)
        for k, s in enumerate(sums):
            for c, v in s.items():
                self.values[self.row[c], k] = v
        rows, self.marks = np.nonzero(self.values)  # few landmarks have a triple, so only those are visited
        self.shares = self.values[rows, self.marks].astype(np.float64)
        self.first = np.searchsorted(rows, np.arange(len(self.values) + 1))

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """A row of kernel values for each word; words of fewer than ORDER letters have none."""
        out = np.zeros((len(words), len(self.landmarks)), dtype=np.float32)
        for part, group in _by_length(words):
            code, weight = _triples(group)
            row = self.row[code].ravel()
            hit = np.flatnonzero(row)
            if len(hit):
                out[part] = self._sums(hit, row[hit], weight, len(part)) / np.maximum(_norms(group), 1e-9)[:, None]
        for k, w in enumerate(words):
            if len(w) > LONGEST:
                own = triple_sums(w)
                held = np.flatnonzero(own)
                out[k] = own[held] @ self.values[self.row[held]] / max(math.sqrt(float(own[held] @ own[held])), 1e-9)
        np.clip(out, 0, 1, out=out)
        return math.prod([out] * POWER)

    def _sums(self, hit: np.ndarray, row: np.ndarray, weight: np.ndarray, words: int) -> np.ndarray:
        """Summed products of the words' triples some landmark has with the landmarks' own, a bounded number at a time."""
        sums = np.zeros(words * len(self.landmarks))
        n = self.first[row + 1] - self.first[row]
        upto = np.cumsum(n)
        cuts = [0, *np.searchsorted(upto, np.arange(AT_ONCE, upto[-1], AT_ONCE)).tolist(), len(hit)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            word, place = np.divmod(hit[a:b], len(weight))
            many = n[a:b]
            at = np.arange(many.sum()) + np.repeat(self.first[row[a:b]] - (np.cumsum(many) - many), many)
            sums += np.bincount(np.repeat(word * len(self.landmarks), many) + self.marks[at], np.repeat(weight[place], many) * self.shares[at], len(sums))
        return sums.reshape(words, -1)


class ToxicityModel:
    """Landmarks, the SVM in their kernel space (weights folded back through K_mm ** -1/2), calibration."""

    def __init__(self, landmarks: list[bytes], weights: np.ndarray, bias: float, slope: float, shift: float, prior: float):
        self.landmarks, self.weights, self.bias, self.slope, self.shift, self.prior = landmarks, weights, bias, slope, shift, prior

    def scorer(self):
        kernel = Kernel(self.landmarks) if self.landmarks else None
        memory: dict[str, int] = {}
        spelling: dict[bytes, int] = {}  # words of equal codes share a row; row 0 is of all that no landmark is like
        table, used = [np.zeros((1 << 14, len(self.landmarks)), dtype=np.float32)], [1]

        def learn(words: list[str]) -> None:
            """The kernel row of each new word."""
            own = all_codes(words)
            new = list(dict.fromkeys(c for c in own if c not in spelling))
            values = kernel(new)
            like = values.any(axis=1)
            begin, end = used[0], used[0] + int(like.sum())
            if end > len(table[0]):
                grown = np.zeros((max(end, 2 * len(table[0])), len(self.landmarks)), dtype=np.float32)
                grown[:begin] = table[0][:begin]
                table[0] = grown
            table[0][begin:end] = values[like]
            used[0] = end
            spelling.update(zip(new, np.where(like, begin + np.cumsum(like) - 1, 0).tolist()))
            memory.update(zip(words, map(spelling.__getitem__, own)))

        def run(texts: list[str]) -> list[float]:
            if kernel is None:
                return [self.prior] * len(texts)
            out = []
            long = np.unique(np.cumsum([len(t) for t in texts]) // CHARS, return_index=True)[1]
            cuts = sorted({*range(0, len(texts), 250), *long.tolist(), len(texts)})
            for a, b in zip(cuts[:-1], cuts[1:]):  # new words of many texts are compared at once
                parsed = [sentences(t) for t in texts[a:b]]
                words = [w for parts in parsed for p in parts for w in p]
                new = set(words).difference(memory)
                if len(memory) + len(new) > REMEMBER:
                    memory.clear()
                    spelling.clear()
                    used[0], new = 1, set(words)
                if new:
                    learn(list(new))
                out += worst(parsed, np.fromiter(map(memory.__getitem__, words), dtype=np.int64, count=len(words)))
            return out

        def worst(parsed: list[list[list[str]]], rows: np.ndarray) -> list[float]:
            """Each text's score; one without a sentence is judged as an all-zero one."""
            margin = np.full(len(parsed), self.bias, dtype=np.float64)
            n = np.array([len(parts) for parts in parsed])
            if n.any():
                first = np.cumsum([0, *(len(p) for parts in parsed for p in parts)])[:-1]
                keep = rows > 0  # an all-zero row changes no maximum beside others
                keep[first] = True
                first = (np.cumsum(keep) - 1)[first]
                each = np.concatenate(list(self._margins(table[0], rows[keep], first)))
                margin[n > 0] = np.maximum.reduceat(each, (np.cumsum(n) - n)[n > 0])
            return [1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * m + self.shift)))) for m in margin.tolist()]

        return run

    def _margins(self, table: np.ndarray, rows: np.ndarray, first: np.ndarray):
        """Margins of sentences, given their words' rows; long texts in parts."""
        cuts = np.unique(np.append(np.searchsorted(first, np.arange(0, len(rows), 20_000)), len(first)))
        for a, b in zip(cuts[:-1], cuts[1:]):
            low, high = first[a], first[b] if b < len(first) else len(rows)
            yield np.maximum.reduceat(table[rows[low:high]], first[a:b] - low, axis=0) @ self.weights + self.bias

    def column(self, text: Column) -> Column:
        return text_udf(self.scorer, "double", pa.float64())(text)


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, reg: float = REG, steps: int = 40) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on the rows inside the margin; y is +-1, cost weighs the rows."""
    x1 = np.hstack((x, np.ones((len(x), 1), dtype=x.dtype)))
    cost = cost / cost.sum()
    ridge = np.full(x1.shape[1], reg)
    ridge[-1] = 1e-9
    w = np.zeros(x1.shape[1])

    def loss(v: np.ndarray, out: np.ndarray) -> float:
        slack = np.maximum(0, 1 - y * out)
        return float(cost @ (slack * slack)) + float(ridge @ (v * v))

    out = x1 @ w
    held = loss(w, out)
    for _ in range(steps):
        near = np.flatnonzero(y * out < 1)
        part = x1[near].astype(np.float64)
        weighed = part * cost[near][:, None]
        aim = np.linalg.solve(part.T @ weighed + np.diag(ridge), weighed.T @ y[near])
        size = 1.0
        while True:
            new = w + size * (aim - w)
            new_out = x1 @ new
            got = loss(new, new_out)
            if got < held or size < 1e-4:
                break
            size /= 2
        gain, w, out, held = held - got, new, new_out, min(got, held)
        if gain < 1e-9:
            break
    return w[:-1], float(w[-1])


def inserted(word: str) -> str:
    """A word of five letters or more with one more letter inside; place and letter follow from the word."""
    if len(word) < 5:
        return word
    h = zlib.crc32(word.encode("utf-8", "replace"))
    at = 1 + h % (len(word) - 1)
    return word[:at] + "abcdefghijklmnopqrstuvwxyz"[h // 64 % 26] + word[at:]


def _landmarks(bags: Iterable[set[bytes]], label: np.ndarray, limit: int) -> tuple[list[bytes], np.ndarray]:
    """Words that set the classes apart, clean words a toxic landmark could be confused with, common words; and each one's evidence."""
    df = [Counter(), Counter()]
    for y, bag in zip(label.tolist(), bags):
        df[y].update(w for w in bag if ORDER <= len(w) <= LONGEST)
    a, b = int(label.sum()), int(len(label) - label.sum())
    least = max(3, a * MIN_SHARE)
    odds = {w: (n + 0.5) / a / ((df[0][w] + 0.5) / b) for w, n in df[1].items() if n >= least and len(w) >= 4}
    weight = {w: df[1][w] * math.log(r) for w, r in odds.items() if r >= MIN_ODDS}
    ranked = sorted(weight, key=lambda w: (-weight[w], w))
    chosen: list[bytes] = []
    for k in range(0, len(ranked), 512):  # one landmark for a family of like words
        if len(chosen) == limit * 3 // 4:
            break
        block = ranked[k : k + 512]
        near = Kernel(chosen)(block).max(axis=1, initial=0) if chosen else np.zeros(len(block))
        alike = Kernel(block)(block)
        for i, w in enumerate(block):
            if len(chosen) < limit * 3 // 4 and near[i] < 0.7:
                chosen.append(w)
                near = np.maximum(near, alike[:, i])
    common = sorted((w for w in df[0] if w not in weight), key=lambda w: (-df[0][w], w))
    alike = np.zeros(len(common))
    if chosen:
        kernel = Kernel(chosen)
        for k in range(0, len(common), 20_000):
            alike[k : k + 20_000] = kernel(common[k : k + 20_000]).max(axis=1, initial=0)
    confused = sorted(np.flatnonzero(alike >= CONFUSED).tolist(), key=lambda k: (-df[0][common[k]] * float(alike[k]), common[k]))[: limit // 6]
    taken = set(confused)
    chosen += [common[k] for k in confused] + [w for k, w in enumerate(common) if k not in taken][: limit // 12]
    return chosen, np.array([max(0.0, weight.get(w, 0.0)) for w in chosen])


def train(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS) -> ToxicityModel:
    """Choose landmarks, then the multiple-instance SVM and its calibration."""
    if not toxic or not clean:
        return ToxicityModel([], np.zeros(0), 0.0, 1.0, 0.0, 1.0 if toxic else 0.0)
    toxic, clean = list(dict.fromkeys(toxic)), list(dict.fromkeys([*clean, ""]))  # copies would count as evidence; no text is clean
    plain = [sentences(t) for t in (*toxic, *clean)]
    label = np.array([1] * len(toxic) + [0] * len(clean))
    chosen, evidence = _landmarks(({codes(w) for s in bag for w in s} for bag in plain), label, landmarks)
    a, b = len(toxic), len(clean)
    if not chosen:
        return ToxicityModel([], np.zeros(0), 0.0, 1.0, 0.0, a / (a + b))
    kernel = Kernel(chosen)
    value, vector = np.linalg.eigh(kernel(chosen).astype(np.float64) + 1e-6 * np.eye(len(chosen)))
    root = vector @ np.diag(np.maximum(value, 1e-6) ** -0.5) @ vector.T

    both = np.array([1] * a + [0] * b + [1] * a)
    place: dict[bytes, int] = {b"": 0}
    owner, at = [], []
    for k in range(len(both)):
        bag = plain[k] if k < a + b else [[inserted(w) for w in s] for s in plain[k - a - b]]
        for s in bag or [[""]]:
            owner.append(k)
            at.append(np.array([place.setdefault(codes(w), len(place)) for w in s], dtype=np.int32))
    del plain
    distinct = list(place)
    table = np.concatenate([kernel(distinct[k : k + 20_000]) for k in range(0, len(distinct), 20_000)])
    owner = np.array(owner)
    raw = np.zeros((len(owner), len(chosen)), dtype=np.float32)
    for k in range(0, len(at), 5000):
        part = at[k : k + 5000]
        first = np.cumsum([0, *map(len, part[:-1])])
        raw[k : k + 5000] = np.maximum.reduceat(table[np.concatenate(part)], first, axis=0)
    x = raw @ root.astype(np.float32)
    y = np.where(both[owner] == 1, 1.0, -1.0)
    negative = np.flatnonzero(y < 0)
    margin = raw @ evidence
    for _ in range(4):  # witnesses of the toxic documents, then the machine, in turn
        best: dict[int, int] = {}
        for k in np.flatnonzero(y > 0):
            if owner[k] not in best or margin[k] > margin[best[owner[k]]]:
                best[owner[k]] = k
        rows = np.concatenate((np.array(sorted(best.values()), dtype=np.int64), negative))
        weight = np.where(owner[rows] < a, 1.0, INSERTED)
        cost = np.where(y[rows] > 0, 0.5 * weight / weight[: len(best)].sum(), 0.5 / len(negative))
        w, bias = _svm(x[rows], y[rows], cost)
        margin = x @ w + bias
    worst = np.full(len(both), -np.inf)
    np.maximum.at(worst, owner, margin)
    worst = worst[: a + b]
    slope, shift = 2.0, 0.0
    for _ in range(300):  # logistic calibration of the documents' margins, classes balanced
        p = 1 / (1 + np.exp(-np.clip(slope * worst + shift, -60, 60)))
        g = (p - label) * np.where(label == 1, 0.5 / a, 0.5 / b)
        slope, shift = max(0.1, slope - 4 * float(g @ worst) - 1e-4 * slope), shift - 4 * float(g.sum())
    return ToxicityModel(chosen, (root @ w).astype(np.float32), bias, slope, shift, a / (a + b))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "toxic", max_train: int = MAX_TRAIN) -> ToxicityModel:
    """Learn from at most `max_train` rows of each class whose doc_id satisfies `usable`."""
    named = labels.where(labels[label].isNotNull() & labels["doc_id"].isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    named = named.where(usable) if usable is not None else named
    texts: list[list[str]] = []
    for y in (1, 0):
        ids = bounded_sample(named.where(F.col("y") == y).select("doc_id").distinct(), F.col("doc_id"), max_train)
        rows = docs.select("doc_id", text_of(docs).alias("text")).join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        texts.append([r.text for r in sorted(rows.toLocalIterator(), key=lambda r: r.doc_id)])
    return train(*texts)


def score(docs: DataFrame, labels: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; `held_out` maps a doc_id column to a boolean one."""
    model = fit(docs, labels, ~held_out(F.col("doc_id")))
    out = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), model.column(text_of(docs)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
