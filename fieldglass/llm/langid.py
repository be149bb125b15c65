"""Language identification by error-correcting output codes.

Each language gets a codeword; a linear classifier on hashed byte n-grams (2 to 4 bytes) predicts each bit, and
loss-weighted decoding picks the language whose codeword has the least summed hinge loss. The score is the margin
between the best two codewords, from 0 to 1; a text whose score is below AMBIGUOUS is flagged ``ambiguous``.

The classifiers learn from about ``sample_per_lang`` texts of each language, chosen by a hash, and about SAMPLE_ROWS in
all, which bounds what the driver gets (8 KB a text); their features are counted on the executors over whole texts.
Prediction reads whole texts and nothing else. A text without letters, or null, is ``und`` with score 0, flagged; with
one language to learn from, all others get it with score 1; with none, ``und``. Documents without doc_id are predicted,
and not learned from. Repeated rows give equal results, an empty table an empty one; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed n-gram features; texts of each language and in all to learn from, about.
FEATURES, SAMPLE_PER_LANG, SAMPLE_ROWS = 4096, 400, 16_000
#: Bits of codewords beyond the exhaustive code; the score under which a prediction is ambiguous.
RANDOM_BITS, AMBIGUOUS = 31, 0.1
LETTER = re.compile(r"[^\W\d_]")
#: Bytes whose features are counted at a time.
SLICE = 1 << 20


def features(texts: list[str]) -> np.ndarray:
    """A row for each text: square roots of the shares of its hashed n-grams."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for row, text in zip(out, texts, strict=True):
        raw = np.frombuffer(f" {text} ".encode(), np.uint8)
        counts = np.zeros(FEATURES, np.int64)
        for at in range(0, len(raw), SLICE):
            b = raw[at : at + SLICE + 3].astype(np.uint32)
            code = b * np.uint32(2654435761)
            for n in range(1, 4):
                code = (code[:-1] ^ b[n:]) * np.uint32(2246822519)
                code ^= code >> np.uint32(15)
                counts += np.bincount(code[:SLICE] >> np.uint32(20), minlength=FEATURES)
        np.sqrt(counts / max(1, counts.sum()), out=row)
    return out


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of -1 and 1: the exhaustive code up to 5 classes, else the random code with the widest least distance."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 5:
        return np.array([(1, *x) for x in itertools.product((1, -1), repeat=k - 1)][1:], float).T
    rng, best, wide = np.random.default_rng(seed), None, -1
    for _ in range(500):
        code = rng.choice([-1.0, 1.0], (k, RANDOM_BITS))
        least = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2)) if k <= 60 else RANDOM_BITS
        if least > wide and (abs(code.sum(0)) < k).all():
            best, wide = code, least
    return best


def fit(x: np.ndarray, y: np.ndarray, code: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of one logistic classifier for each bit, by accelerated gradient descent on all rows."""
    target = code[y]
    share = np.bincount(y, minlength=len(code))
    weight = (1 / share[y])[:, None] / (share > 0).sum()
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = w.copy(), b.copy()
    for i in range(rounds):
        g = -(weight * target / (1 + np.exp(np.clip(target * (x @ vw + vb), -30, 30)))).astype(np.float32)
        nw, nb = vw - 4 * (x.T @ g + ridge * vw), vb - 4 * g.sum(0)
        pace = i / (i + 3)
        vw, vb = nw + pace * (nw - w), nb + pace * (nb - b)
        w, b = nw, nb
    return w, b


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of least hinge loss and score for each row of bit margins; bits count by how sure they are on the row."""
    if len(code) < 2:
        return np.zeros(len(margins), int), np.ones(len(margins))
    loss = np.stack([np.maximum(0, 1 - np.clip(margins, -4, 4) * c).mean(1) for c in code], 1)
    two = np.sort(loss, 1)[:, :2]
    return loss.argmin(1), np.clip((two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1e-9), 0, 1)


def learn(labelled: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, code, weights and offsets from labelled(doc_id, text, lang), without nulls."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    langs = sorted(counts)
    if not langs:
        return [], np.ones((0, 1)), np.zeros((FEATURES, 1), np.float32), np.zeros(1, np.float32)
    each = min(sample_per_lang, max(1, SAMPLE_ROWS // len(langs)))
    odds = F.from_json(F.lit(json.dumps({s: min(1.0, each / n) for s, n in counts.items()})), "map<string, double>")
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = labelled.filter(F.col("doc_id").isNotNull() & (chance < F.try_element_at(odds, F.col("lang"))))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"lang": pdf["lang"], "x": [r.astype("<f2").tobytes() for r in features(pdf["text"].tolist())]})

    seen = sorted(chosen.select("lang", "text").mapInPandas(count, "lang string, x binary").collect())
    code = codewords(len(langs))
    if not seen:
        return langs, code, np.zeros((FEATURES, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    x = np.stack([np.frombuffer(r["x"], "<f2") for r in seen]).astype(np.float32)
    return langs, code, *fit(x, np.array([langs.index(r["lang"]) for r in seen]), code)


def predict_languages(docs: DataFrame, model: tuple) -> DataFrame:
    """docs(doc_id, text, held_out) -> doc_id, held_out, lang_pred, score, ambiguous. The model is a few hundred KB."""
    langs, code, w, b = model

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            use = [i for i, t in enumerate(texts) if LETTER.search(t)] if langs else []
            for at in range(0, len(use), 500):
                some = use[at : at + 500]
                best, score = decode(features([texts[i] for i in some]) @ w + b, code)
                for i, c, s in zip(some, best, score, strict=True):
                    names[i], scores[i] = langs[c], float(s)
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].astype("Int64"),
                    "held_out": pdf["held_out"],
                    "lang_pred": names,
                    "score": scores,
                    "ambiguous": [x < AMBIGUOUS for x in scores]
                }
            )

    return docs.select("doc_id", "text", "held_out").mapInPandas(
        guess,
        "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )


def identify_languages(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """Learn from documents outside the held-out third, predict all; see the contract of op9."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    marked = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = learn(marked.filter("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL"), sample_per_lang)
    return predict_languages(marked, model)
