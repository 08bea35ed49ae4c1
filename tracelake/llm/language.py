"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside of it.

Features are hashed character n-grams (lengths 1 to 4 within words, case folded), as relative
frequencies with a square root, scaled to unit length. Training takes a bounded sample of labelled rows
chosen by a hash of doc_id, as many of each language; the linear support vector machines are trained on
the driver by dual coordinate descent. The model has FEATURES weights a machine and is sent out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracelake.llm.common import annotate, sent_if_small

FEATURES = 1 << 13
#: Training documents of a language at most, and of all languages together: where there are very many languages, each has fewer.
PER_LANGUAGE, ALL_LANGUAGES = 300, 60_000
#: Families of languages, by ISO 639-1 code: fixed values. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt",
    "indo-aryan": "hi bn mr gu pa ur ne",
    "semitic": "ar he mt am",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}").search


def family(language: str) -> str:
    return _FAMILY.get(language.lower(), language)


def features(text: str) -> np.ndarray:
    """Unit vector of hashed n-gram frequencies; runs of what isn't a letter count as one space."""
    codes = np.frombuffer(" ".join(["", *text.lower().split(), ""]).encode("utf-32-le"), "<u4").astype(np.uint32)
    if len(codes) < 2:
        return np.zeros(FEATURES, np.float32)
    letter = (codes >= 97) & (codes <= 122) | (codes >= 0xAA)
    codes = np.where(letter, codes, np.uint32(32))
    codes = codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]
    total, h = np.zeros(FEATURES, np.int64), np.zeros(len(codes), np.uint32)
    for n in range(1, 5):
        if n > len(codes):
            break
        h = h[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        total += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(19), minlength=FEATURES)
    found = np.sqrt(total.astype(np.float32))
    return found / max(float(np.linalg.norm(found)), 1e-12)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 15) -> np.ndarray:
    """Weights of an L2-loss linear SVM (no bias: vectors have unit length) by dual coordinate descent; y is +1 or -1."""
    x = x.astype(np.float64)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    square = (x * x).sum(1) + 0.5 / c
    order = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(x)):
            row = x[i]
            slope = y[i] * w.dot(row) - 1 + alpha[i] * 0.5 / c
            step = max(alpha[i] - slope / square[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += (step * y[i]) * row
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


class Model:
    """Machines between families and, for each family, between its languages."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        names, kinds = np.array(languages), np.array([family(x) for x in languages])
        self.families = self.machines(x, kinds, sorted(set(kinds)))
        self.inside = {f: self.machines(x[kinds == f], names[kinds == f], sorted(set(names[kinds == f]))) for f in sorted(set(kinds))}

    @staticmethod
    def machines(x: np.ndarray, y: np.ndarray, classes: list[str]) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
        pairs = list(combinations(range(len(classes)), 2))
        weights = np.zeros((len(pairs), FEATURES), np.float32)
        for k, (a, b) in enumerate(pairs):
            of = (y == classes[a]) | (y == classes[b])
            weights[k] = train_svm(x[of], np.where(y[of] == classes[a], 1.0, -1.0))
        return classes, pairs, weights

    @staticmethod
    def vote(machines: tuple, v: np.ndarray) -> tuple[str, float]:
        """The class that wins most duels, margins deciding ties, and the mean of its duels' logistic margins."""
        classes, pairs, weights = machines
        if not pairs:
            return classes[0], 1.0
        margin = weights @ v
        wins, sums = np.zeros(len(classes)), np.zeros(len(classes))
        for (a, b), m in zip(pairs, margin.tolist(), strict=True):
            p = 1 / (1 + np.exp(-min(max(3 * m, -30), 30)))
            wins[a if m >= 0 else b] += 1
            sums[a] += p
            sums[b] += 1 - p
        best = int(np.lexsort((-sums, -wins))[0])
        return classes[best], float(sums[best] / (len(classes) - 1))

    def predict(self, text: str) -> tuple[str, float]:
        if not _LETTER(text):
            return "und", 0.0
        v = features(text)
        kind, sure = self.vote(self.families, v)
        language, within = self.vote(self.inside[kind], v)
        return language, sure * within


def held_out():
    """Whether a document is kept from training: crc32 of its doc_id, as text, is a multiple of 5. A null id: no."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame) -> DataFrame:
    """(lang, text): up to PER_LANGUAGE documents of each value of lang, by a hash of doc_id; one of each at least."""
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = known.groupBy("lang").count()
    languages = sizes.count()
    per = max(1, min(PER_LANGUAGE, ALL_LANGUAGES // max(1, languages)))
    # a hash thins each language to about twice the wanted number before any rows of one meet; one that has few keeps all.
    # The sizes are sent to the rows, or the join would deal out all rows by language first
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    some = known.select("doc_id", "lang", place.alias("place")).join(sent_if_small(sizes, languages), "lang").where((F.col("place").cast("double") * F.col("count") < 2.0 * per * (1 << 30)) | (F.col("count") <= 20))
    spread = Window.partitionBy("lang").orderBy("place", "doc_id")
    ids = some.withColumn("n", F.row_number().over(spread)).where(F.col("n") <= per).select("doc_id", F.col("lang").alias("l"))
    # at most ALL_LANGUAGES ids, or one of each language
    return known.join(F.broadcast(ids.dropDuplicates(["doc_id"])), "doc_id").where("lang = l").select("lang", "text")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of docs (doc_id, text, lang).

    A text that is null or has no letter is ``und`` with score 0. Without any labelled row that may be
    learned from, every text is ``und``. lang serves training only; every language of a training document is
    learned. Of languages that win as many duels the one with the larger margins is told, then the first in
    order. A very long text is weighed as a whole. Repeated rows give repeated results;
    an empty table none; other columns are left aside.
    """
    rows = training_sample(docs).toArrow()
    texts, languages = rows["text"].to_pylist(), rows["lang"].to_pylist()
    order = sorted((i for i in range(len(texts)) if _LETTER(texts[i])), key=lambda i: (languages[i], texts[i]))
    model = Model(np.stack([features(texts[i]) for i in order]), [languages[i] for i in order]) if order else None
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(values):
        found = [sent.value.predict(v or "") if sent.value else ("und", 0.0) for v in values]
        return [[x[0] for x in found], [x[1] for x in found]]

    asked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return annotate(asked, ["text"], [("lang_pred", T.StringType()), ("score", T.DoubleType())], predict).select("doc_id", "held_out", "lang_pred", "score")
