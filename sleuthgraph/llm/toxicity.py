"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel compares two segments of a sentence (words with marked ends; words
with marks or repeated letters inside also without them; letters that stand
alone in a row joined, whole and in windows) by their common subsequences of four
characters inside windows of six, each worth ``DECAY`` to the power of what it
spans; so inserted or left-out characters cost a little and no more.  Landmarks
are words that set toxic training sentences apart, and common words; a squared-hinge
machine is fitted in the Nyström space of the landmarks, on the segment of each
toxic text that the previous round finds most toxic (and copies of it with
inserted characters) against segments of clean texts, hardest first.  Since the
kernel has explicit features, landmarks and weights fold into one vector, and a
segment is scored by adding up its subsequences.  A text is scored by its two
most toxic segments, with a logistic scale fitted on the training texts and on
clean ones in which one witness, plain or with inserted characters, is put.

Labels are read from at most ``MAX_TRAIN_ROWS`` training texts, half of either
kind; no held-out row is among them.

Nulls and ties: a null text counts as empty and has a score; labels without a
text are ignored; texts that occur twice train once; without both labels the score is
the smoothed share; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN_ROWS = 3_000
THRESHOLD = 0.7
ORDER = 4
WINDOW = 6
DECAY = 0.7
FEATURES = 1 << 18
SEGMENT = 24
OVERLAP = 6
LANDMARKS = 320
ROUNDS = 8
HARD = 1_000  # hardest clean segments of a round
USUAL = 0.3  # share of the most frequent witness's texts that a planted witness has at least
PLANTED = 0.05  # weight of all texts with a planted witness, in toxic texts
SCORED_SEGMENTS = 1_000_000

ALONE = re.compile(r"(?<!\S)\S(?:[^\S\n]+\S){2,}(?!\S)")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[\W_]+")
REPEATED = re.compile(r"(.)\1+")
SPACED = range(4, 13)  # lengths of the windows of a spaced-out run
# offsets of the later characters of a subsequence behind its first
STEPS = [s for s in itertools.combinations(range(1, WINDOW), ORDER - 1)]


def segments(text: str | None) -> set[str]:
    """The distinct segments of a text: its words in lower case with their plainer forms, and single characters in a row joined."""
    low = (text or "").lower()
    found = set()
    for word in set(low.split()):
        found.update(forms(word))
    for run in ALONE.findall(low):
        joined = "".join(run.split())
        found.add(joined)
        found.update(joined[k:k + n] for n in SPACED for k in range(len(joined) - n + 1))
    return found


@lru_cache(maxsize=SCORED_SEGMENTS // 4)
def forms(word: str) -> tuple[str, ...]:
    """The word without marks at its ends; also without marks inside, and without repeated letters if it has several."""
    bare = word if word.isalnum() else EDGES.sub("", word)
    out = [bare]
    if not bare.isalnum():
        inner = INNER.sub("", bare)
        if len(inner) >= ORDER:
            out.append(inner)
    single = REPEATED.sub(r"\1", out[-1])
    if len(out[-1]) - len(single) >= 2 and len(single) >= ORDER:
        out.append(single)
    return tuple(out)


def parts(segment: str) -> list[str]:
    """The segment without marks at its ends; long ones in overlapping parts."""
    bare = EDGES.sub("", segment)
    if len(bare) <= SEGMENT:
        return [bare]
    return [bare[k:k + SEGMENT] for k in range(0, len(bare) - OVERLAP, SEGMENT - OVERLAP)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, weight) of each word's subsequences, in rows of equal length; weights have norm 1 in a row."""
    width = SEGMENT + 2
    text = np.array([f"\x02{w}\x03" for w in words], dtype=f"<U{width}")
    codes = text.view(np.uint32).reshape(len(words), width)
    if codes.shape[1] < width + WINDOW:
        codes = np.pad(codes, ((0, 0), (0, WINDOW)))
    ids, weights = [], []
    for step in STEPS:
        h = codes[:, :width].astype(np.uint64)
        there = codes[:, step[-1]:step[-1] + width] > 0
        for d in step:
            h = h * np.uint64(0x100000001B3) + codes[:, d:d + width]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        ids.append(((h >> np.uint64(40)) % np.uint64(FEATURES)).astype(np.int32))
        weights.append(np.where(there, np.float32(DECAY ** (step[-1] + 1)), np.float32(0)))
    ids, weights = np.concatenate(ids, axis=1), np.concatenate(weights, axis=1)
    norm = np.sqrt((weights ** 2).sum(axis=1, keepdims=True))
    return ids, weights / np.maximum(norm, 1e-9)


@dataclass(frozen=True)
class Model:
    vector: np.ndarray | None  # landmarks times weights, over the features
    bias: float
    scale: tuple[float, float, float, float]  # logistic: of the best, the second, the log count; intercept

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), dtype=np.float32)
        for k in range(0, len(words), 4096):
            ids, weights = subsequences(words[k:k + 4096])
            out[k:k + 4096] = (self.vector[ids] * weights).sum(axis=1) + self.bias
        return out

    def chance(self, best, second, count):
        z = self.scale[0] * best + self.scale[1] * second + self.scale[2] * np.log1p(count) + self.scale[3]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Scorer:
    """Margins of segments, remembered in a store of bounded size."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def top(self, texts: list[set[str]]) -> np.ndarray:
        """(best, second, count) of each set of segments; the floor is -2."""
        if len(self.known) > SCORED_SEGMENTS:
            self.known.clear()
        fresh = sorted(set().union(*texts).difference(self.known)) if texts else []
        pieces = [parts(s) for s in fresh]
        flat = self.model.margins([p for ps in pieces for p in ps]).tolist()
        at = 0
        for s, ps in zip(fresh, pieces, strict=True):
            self.known[s] = max(flat[at:at + len(ps)])
            at += len(ps)
        out = np.full((len(texts), 3), -2.0)
        for k, found in enumerate(texts):
            best = second = -2.0
            for v in map(self.known.__getitem__, found):
                if v > second:
                    best, second = (v, best) if v > best else (best, v)
            out[k] = max(best, -2.0), max(second, -2.0), len(found)
        return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Squared hinge with an L2 penalty, by Newton steps over the rows that violate the margin."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    keep = ridge * len(x) * np.eye(len(w))
    keep[-1, -1] = 1e-6
    for _ in range(12):
        active = y * (a @ w) < 1
        d = cost * active
        new = np.linalg.solve(a.T @ (a * d[:, None]) + keep, a.T @ (d * y))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def _varied(words: list[str], rng) -> list[str]:
    """The words, each also with one or two inserted characters."""
    marks, out = ".*-_x1", list(words)
    for w in words:
        for n in (1, 2):
            v = w
            for _ in range(n):
                k = int(rng.integers(1, max(len(v), 2)))
                v = v[:k] + marks[int(rng.integers(len(marks)))] + v[k:]
            out.append(v[:SEGMENT])
    return out


def train(toxic: list[set[str]], clean: list[set[str]], seed: int = 11) -> Model:
    """Fit on the segment sets of toxic and of clean texts."""
    if not toxic or not clean:
        share = (len(toxic) + 1) / (len(toxic) + len(clean) + 2)
        return Model(np.zeros(FEATURES, dtype=np.float32), 0.0, (0.0, 0.0, 0.0, math.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    sets = [[{p for s in t for p in parts(s)} for t in texts] for texts in (toxic, clean)]
    n1, n0 = (Counter(w for t in texts for w in t) for texts in sets)
    common = sorted(n0, key=lambda w: (-n0[w], w))
    # words that many toxic texts have and hardly any clean one
    odds = {w: n * math.log((n / len(toxic)) / ((n0[w] + 0.5) / len(clean))) for w, n in n1.items()
            if n >= 2 and n / len(toxic) > 5 * (n0[w] + 0.5) / len(clean) * (len(clean) / (len(clean) + 10))}
    seeds = sorted(odds, key=lambda w: (-odds[w], w))[:2 * LANDMARKS // 3]
    if not seeds:
        seeds = sorted(n1, key=lambda w: (n0[w] - n1[w], w))[:LANDMARKS // 3]
    marks = seeds + common[:LANDMARKS - len(seeds)]
    marks = list(dict.fromkeys(marks))
    ids, weights = subsequences(marks)
    # only features that a landmark has count in the kernel; column 0 takes the others
    used = np.unique(ids[weights > 0])
    column = np.zeros(FEATURES, dtype=np.int64)
    column[used] = np.arange(1, len(used) + 1)

    def spread(i: np.ndarray, w: np.ndarray) -> np.ndarray:
        flat = np.arange(len(i))[:, None] * (len(used) + 1) + column[i]
        out = np.bincount(flat.ravel(), w.ravel(), len(i) * (len(used) + 1)).reshape(len(i), -1).astype(np.float32)
        out[:, 0] = 0
        return out

    landmarks = np.concatenate([spread(ids[k:k + 64], weights[k:k + 64]) for k in range(0, len(ids), 64)])

    def kernel(words: list[str]) -> np.ndarray:
        return np.concatenate([spread(*subsequences(words[k:k + 64])) @ landmarks.T for k in range(0, len(words), 64)])

    gram = landmarks @ landmarks.T
    values, vectors = np.linalg.eigh(gram.astype(float))
    root = vectors[:, values > 1e-4] / np.sqrt(values[values > 1e-4])
    benign = sorted(n0)
    positive = first = seeds[:60]
    hard = common[:1500] + [benign[k] for k in rng.choice(len(benign), min(len(benign), 1500), replace=False)]
    model = None
    for _ in range(ROUNDS):
        pos = _varied(positive, rng)
        neg = list(dict.fromkeys(hard))
        x = kernel(pos + neg) @ root
        y = np.append(np.ones(len(pos)), -np.ones(len(neg)))
        cost = np.append(np.full(len(pos), len(neg) / max(len(pos), 1)), np.ones(len(neg)))
        w, bias = _svm(x, y, np.minimum(cost, 20))
        vector = np.zeros(FEATURES, dtype=np.float32)
        vector[used] = (landmarks.T @ (root @ w))[1:]
        model = Model(vector, bias, (0.0, 0.0, 0.0, 0.0))
        scores = dict(zip(benign, model.margins(benign).tolist(), strict=True))
        hard = hard[:3000] + sorted(benign, key=lambda v: (-scores[v], v))[:HARD]
        # the witness of a toxic text: its most toxic segments that clean texts do not have
        mine = sorted({v for t in sets[0] for v in t if not n0[v]})
        score = dict(zip(mine, model.margins(mine).tolist(), strict=True))
        found = Counter(v for t in sets[0] for v in sorted((v for v in t if v in score), key=lambda v: (-score[v], v))[:2]
                        if score[v] > 0)
        positive = [v for v, _ in sorted(found.items(), key=lambda p: (-p[1], p[0]))[:700]] or positive
    scorer = Scorer(model)
    top = scorer.top(toxic + clean)
    # clean texts with one witness put in: words that a good share of the toxic texts have
    usual = [v for v in first if n1[v] >= USUAL * n1[first[0]]]
    planted = scorer.top([set(forms(v)) for v in usual])[:, 0]
    planted = planted[rng.integers(len(planted), size=len(clean))]
    below = top[len(toxic):]
    put = np.stack([np.maximum(planted, below[:, 0]), np.maximum(np.minimum(planted, below[:, 0]), below[:, 1]), below[:, 2]], axis=1)
    top = np.concatenate([top, put])
    a = np.stack([top[:, 0], top[:, 1], np.log1p(top[:, 2]), np.ones(len(top))], axis=1)
    y = np.concatenate([np.ones(len(toxic)), np.zeros(len(clean)), np.ones(len(put))])
    weight = np.concatenate([np.ones(len(toxic) + len(clean)), np.full(len(put), PLANTED * len(toxic) / len(put))])
    return Model(model.vector, model.bias, _scale(a, y, weight))


def _scale(a: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> tuple:
    w = np.zeros(a.shape[1])
    keep = np.diag([ridge] * (a.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p) + 1e-6)[:, None]).T @ a + keep, a.T @ (weight * (y - p)) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    halves = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for k in (1, 0)]
    # the sample is the small side: at most max_rows rows of two numbers
    sample = docs.select("doc_id", "text").join(F.broadcast(halves[0].unionByName(halves[1])), "doc_id")

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "digest": [hash_of(t) for t in batch["text"]],
                                "found": [sorted(segments(t)) for t in batch["text"]]})

    rows = sample.select("toxic", "text").mapInPandas(run, "toxic int, digest string, found array<string>")
    rows = rows.toPandas().sort_values(["digest", "toxic"]).drop_duplicates(["digest", "toxic"])
    return train(*[[set(f) for f in rows.loc[rows["toxic"] == k, "found"]] for k in (1, 0)])


def hash_of(text: str | None) -> str:
    import hashlib
    return hashlib.md5((text or "").encode("utf-8", "surrogatepass")).hexdigest()


def scored(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; 1 is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows))

    def run(batches):
        model = shared.value
        scorer = Scorer(model)
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.iloc[k:k + 256]
                top = scorer.top([segments(t) for t in part["text"]])
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": model.chance(top[:, 0], top[:, 1], top[:, 2])})

    found = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted"))
