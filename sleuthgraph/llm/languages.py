"""Language of a text by error-correcting output codes over binary n-gram classifiers.

Every language has a codeword; each bit parts the languages in two sides and has
a logistic classifier of its own over hashed byte n-grams (two and three letters,
words with marked ends).  A text gets one margin for each bit, and the nearest
codeword by loss-weighted decoding is its language: the logistic loss of the margins
against the codeword, each bit weighted by how well its classifier knew that language
in training.  A text is flagged as ambiguous when the hard bits are further from the
chosen codeword than the code corrects, or when a second codeword is about as near.

Up to seven languages get the exhaustive code; more get the best of several drawn
codes, by the least distance between two codewords.  Training takes at most
``MAX_TRAIN_ROWS`` texts, as many of each language, each also as a short cut of
itself, so that short texts have fair margins.

Nulls and ties: a null or empty text, or one without a letter, is ``und`` with score 0;
rows without a language, or without a letter, do not train; rows without an id are
held out; repeated rows are predicted each; of equally near codewords the first
language in UTF-8 order wins; with one learned language every text with a letter is
that one; with none every text is ``und``; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_TRAIN_ROWS = 1_600
FEATURES = 1 << 12
PIECE = 1 << 20
CUT = (40, 240)
RIDGE = 1e-4
STEPS = 150
PARTS = 40
SCALE = 24.0
NEAR = 0.75
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
# ASCII letters in lower case and all bytes beyond ASCII stay, others part words.
SPACED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """Hashed n-grams of a piece of text, one for each place and length."""
    plain = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(SPACED).split())
    b = np.frombuffer(b" " + plain + b" ", dtype=np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    both = np.concatenate([two, three + np.uint32(1 << 24)]) * np.uint32(0x9E3779B1)
    return (both >> np.uint32(32 - FEATURES.bit_length() + 1)).astype(np.int32)


def pieces(text: str):
    for k in range(0, len(text), PIECE):
        yield text[k:k + PIECE]


def histogram(text: str) -> np.ndarray:
    """How often each n-gram stands in the whole text."""
    out = np.zeros(FEATURES)
    for piece in pieces(text):
        out += np.bincount(grams(piece), minlength=FEATURES)
    return out


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """One row of +1 and -1 for each of ``n`` languages."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 7:
        # all splits into two sides, each once
        splits = np.arange(1, 1 << (n - 1))
        return np.stack([np.where(splits >> k & 1, -1.0, 1.0) for k in range(n)])
    rng, best = np.random.default_rng(seed), (-1, None)
    bits = 10 * int(np.ceil(np.log2(n)))
    for _ in range(60):
        code = rng.permuted(np.tile(np.where(np.arange(n) % 2, 1.0, -1.0)[:, None], bits), axis=0)
        apart = (bits - code @ code.T) / 2 + bits * np.eye(n)
        if apart.min() > best[0]:
            best = (apart.min(), code)
    return best[1]


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows sum to 1

    def margins(self, text: str) -> np.ndarray:
        total, places = np.zeros(self.code.shape[1]), 0
        for piece in pieces(text):
            found = grams(piece)
            total += self.weights[found].sum(axis=0, dtype=np.float64)
            places += len(found)
        return SCALE * total / max(places, 1) + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of rows of margins."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust[None]
        far = loss.sum(axis=2)
        best = far.argmin(axis=1)
        near = np.exp(-self.code.shape[1] * (far - far.min(axis=1, keepdims=True)))
        score = 1 / near.sum(axis=1)
        if len(self.names) < 2:
            return best, score, np.zeros(len(best), dtype=bool)
        apart = ((self.code.shape[1] - self.code @ self.code.T) / 2 + self.code.shape[1] * np.eye(len(self.names))).min()
        wrong = (np.sign(margins) != self.code[best]).sum(axis=1)
        return best, score, (wrong > (apart - 1) // 2) | (np.sort(near, axis=1)[:, -2] > NEAR)


def train(langs: list[str], counts: np.ndarray) -> Model:
    """Fit the bits' classifiers on rows of n-gram counts."""
    names, y = np.unique(np.array(langs, dtype=object), return_inverse=True) if langs else (np.array([], dtype=object), np.zeros(0, int))
    code = codewords(len(names))
    if len(names) < 2:
        return Model(tuple(names), code, np.zeros((FEATURES, 0), dtype=np.float32), np.zeros(0), np.ones((len(names), 0)))
    x = counts * (np.float32(SCALE) / np.maximum(counts.sum(axis=1, keepdims=True), 1))  # four bytes an entry
    side = code[y]
    # both sides of a bit weigh the same
    share = np.stack([np.where(side[:, k] > 0, 0.5 / max((side[:, k] > 0).sum(), 1), 0.5 / max((side[:, k] < 0).sum(), 1))
                      for k in range(code.shape[1])], axis=1)
    w, bias = np.zeros((FEATURES, code.shape[1])), np.zeros(code.shape[1])
    v, c, t = w, bias, 1.0
    step = 4.0 / (float(np.einsum("ij,ij->i", x, x).max()) + 1.0)
    for _ in range(STEPS):
        pull = -side * share / (1 + np.exp(np.clip(side * (x @ v.astype(np.float32) + c), -30, 30)))
        new, new_c = v - step * (x.T @ pull.astype(np.float32) + RIDGE * v), c - step * pull.sum(axis=0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_c + (t - 1) / t2 * (new_c - bias)
        w, bias, t = new, new_c, t2
    right = (side * (x @ w.astype(np.float32) + bias) > 0).astype(float)
    trust = np.stack([right[y == k].mean(axis=0) + 1e-3 for k in range(len(names))])
    return Model(tuple(names), code, w.astype(np.float32), bias, trust / trust.sum(axis=1, keepdims=True))


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _short(text: str) -> str:
    """A part of a text of letters, placed by the text's own length."""
    size = CUT[0] + len(text) * 7919 % (CUT[1] - CUT[0])
    at = len(text) * 104729 % max(len(text) - size, 1)
    return text[at:at + size]


def fit(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on as many texts of each language, those with the smallest hash in each part of their ids."""
    known = (docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
             .select("doc_id", F.col("lang").cast("string").alias("lang")))
    langs = max(known.select("lang").distinct().count(), 1)
    each = max(max_rows // langs, 2)
    parts = min(PARTS, each)
    # drawn from parts of a language's ids, so that no task orders a whole language
    order = Window.partitionBy("lang", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(parts))).orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= each // parts).drop("n")
    # the sample is the small side: at most max_rows pairs of an id and a language
    sample = (docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
              .join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text"))

    def run(batches):
        for batch in batches:
            rows = [(lang, histogram(t)) for lang, text in zip(batch["lang"], batch["text"], strict=True)
                    for t in (text, _short(text or "")) if t and LETTER.search(t)]
            places = [np.flatnonzero(h) for _, h in rows]
            yield pd.DataFrame({"lang": [lang for lang, _ in rows], "at": places,
                                "n": [h[p].astype(np.float32) for (_, h), p in zip(rows, places, strict=True)]})

    rows = sample.mapInPandas(run, "lang string, at array<int>, n array<float>").toPandas()
    counts = np.zeros((len(rows), FEATURES), dtype=np.float32)
    for k, (at, n) in enumerate(zip(rows["at"], rows["n"], strict=True)):
        counts[k, at] = n
    order = np.lexsort((counts @ np.arange(FEATURES, dtype=np.float32), rows["lang"].to_numpy(str))) if len(rows) else []
    return train(rows["lang"].iloc[order].tolist(), counts[order])


def identified(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, max_rows))

    def run(batches):
        model = shared.value
        for batch in batches:
            lettered = [bool(t and LETTER.search(t)) and bool(model.names) for t in batch["text"]]
            margins = np.zeros((len(batch), model.code.shape[1]))
            for k, text in enumerate(batch["text"]):
                if lettered[k]:
                    margins[k] = model.margins(text)
            if model.names:
                best, score, unsure = model.decode(margins)
            else:
                best, score, unsure = np.zeros(len(batch), int), np.zeros(len(batch)), np.zeros(len(batch), bool)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "lang_pred": [model.names[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)],
                "score": np.where(lettered, score, 0.0), "ambiguous": np.where(lettered, unsure, True)})

    found = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
