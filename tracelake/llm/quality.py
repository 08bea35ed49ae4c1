"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (n of 1 and 2) are fitted: the target (documents labelled good and
not toxic) and the raw corpus (all documents), each by the occurrences of the n-grams in whole texts. A
document's importance weight is the likelihood ratio of the two: the sum, over all its n-grams as often as
they occur, of the log ratio of their shares. A ratio is drawn to one by as many standard errors as DOUBT
says, the error being that of the numbers of documents which hold the n-gram: a ratio that few documents
vouch for says nothing, so that the noise of a thousand rare words doesn't drown one insult. The sample is
drawn without replacement by Gumbel top-k: each document's key is its log weight plus Gumbel noise times
TEMPERATURE (it is drawn by its weight to the power 1 / TEMPERATURE), and the k largest keys stay. k is the
number of documents whose weight reaches the cut that best parts labelled documents which the target model
hasn't seen.

Words are kept apart by 63-bit hashes. Pairs of words share buckets, a power of two of at least one for every
PAIRS documents, so both models grow with the corpus.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import annotate, fresh, stored, tidy

#: Rows of totals among the buckets: documents, words and pairs.
DOCUMENTS, WORDS, PAIRED = 0, 1, 2
#: N-grams that a task holds before it merges or hands on its counts.
HELD = 1 << 20
#: What is added to all counts; standard errors by which ratios of words and of pairs are drawn to one; documents that must hold an n-gram.
PRIOR, DOUBT, LEAST = 0.5, (1.25, 5.0), 8
#: Documents for each bucket of pairs, at most. (With more buckets tasks would hand on more rows than words.)
PAIRS = 4
#: Ratios sent out at one time (12 bytes each); more take more passes over the texts.
BLOCK = 4_000_000
TEMPERATURE = 0.25
#: Labelled documents used for the target model and the cut, at most; chosen by a hash of doc_id.
LABELLED = 40_000
#: What a lost good document costs in rejected bad ones, when the cut is chosen.
COST = 4.0
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+").findall
_TOP = np.uint64(1 << 63)


def pair_bits(documents: int) -> int:
    """Bits of a bucket of pairs for so many documents."""
    return max(12, (documents // PAIRS).bit_length())


def grams(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's words and pairs of words, in order, and how often each occurs; a punctuation run is a word."""
    tokens = _TOKEN(text.encode().lower())
    words = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    pairs = ((words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)
    return np.unique(np.concatenate([words >> np.uint64(1), pairs | _TOP]), return_counts=True)


def labelled_sample(labels: DataFrame) -> DataFrame:
    """(id, role): 1 to fit the target, 2 good and 3 bad to choose the cut; at most LABELLED rows.

    Of rows that disagree about a document the worse counts. Null ids and labels without a value are left out.
    """
    each = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg((F.min("quality").eqNullSafe(1) & F.max("toxic").eqNullSafe(0)).alias("good"))
    some = each.orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    held = F.crc32(F.col("id").cast("string")) % 5 == 0
    return some.select("id", F.when(~held & F.col("good"), 1).when(held & F.col("good"), 2).when(~F.col("good"), 3).otherwise(0).alias("role")).where("role > 0")


def counts(docs: DataFrame, sample: DataFrame, bits: int) -> DataFrame:
    """(bucket, docs, seen, good_docs, good_seen): documents that hold a bucket and its occurrences, in all and in the target's."""
    told = docs.select("doc_id", "text").join(F.broadcast(sample.where("role = 1")), F.col("doc_id") == F.col("id"), "left").select(F.coalesce("text", F.lit("")).alias("text"), F.col("role").isNotNull().alias("target"))
    names = ["bucket", "docs", "seen", "good_docs", "good_seen"]

    def merged(parts):
        keys, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return (keys[first], *(np.add.reduceat(v[order], first) for v in values))

    def handed(whole):
        for at in range(0, len(whole[0]), 1 << 16):
            keys, *values = (x[at : at + (1 << 16)] for x in whole)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *[pa.array(v.astype(np.int64)) for v in values]], names=names)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                keys, times = grams(text.as_py(), bits)
                words = int(times[: np.searchsorted(keys, _TOP)].sum())
                keys = np.concatenate([keys, np.array([DOCUMENTS, WORDS, PAIRED], np.uint64)])
                times = np.concatenate([times, [1, words, max(words - 1, 0)]]).astype(np.int32)
                ones = np.ones(len(keys), np.int32)
                parts.append((keys, ones, times, ones * good, times * good))
                held += len(keys)
                if held > HELD:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > HELD // 2:
                        yield from handed(parts.pop())
                        held = 0
        if parts:
            yield from handed(merged(parts))

    each = told.mapInArrow(tidy(run), ", ".join(f"{n} bigint" for n in names))
    return each.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names[1:]])


def log_ratios(docs: DataFrame, sample: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, in order, and their log ratios, but for those whose ratio is one; counts come from all documents.

    Gathered is a row a bucket that at least LEAST documents hold and whose ratio is told from one.
    """
    total = F.col("bucket").isin(DOCUMENTS, WORDS, PAIRED)
    found = stored(counts(docs, sample, bits).where(total | (F.col("docs") >= LEAST)), "buckets")
    totals = {r["bucket"]: r for r in found.where(total).collect()}
    none = np.zeros(0, np.uint64), np.zeros(0)
    if not totals or not totals[DOCUMENTS]["good_docs"]:
        return none
    share = [totals[k]["good_seen"] / totals[k]["seen"] if totals[k]["seen"] else 0.0 for k in (DOCUMENTS, WORDS, PAIRED)]
    if not share[1]:
        return none
    pair = F.col("bucket") < 0
    # a model of pairs that the target has none of says nothing
    expected = F.col("seen") * F.when(pair, share[2]).otherwise(share[1])
    log = F.log((F.col("good_seen") + PRIOR) / (expected + PRIOR))
    error = F.when(pair, DOUBT[1]).otherwise(DOUBT[0]) * F.sqrt(1 / (F.col("good_docs") + PRIOR) + 1 / (F.col("docs") * share[0] + PRIOR))
    rows = found.where(~total).select("bucket", (F.signum(log) * F.greatest(F.abs(log) - error, F.lit(0.0))).alias("ratio")).where("ratio <> 0").toArrow()
    keys, values = rows["bucket"].to_numpy().view(np.uint64), rows["ratio"].to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def likelihood_ratio(text: str, bits: int, keys: np.ndarray, values: np.ndarray) -> float:
    """The log of a text's likelihood ratio, as far as the buckets ``keys`` go; the others have ratio one."""
    if not len(keys):
        return 0.0
    own, times = grams(text, bits)
    at = np.searchsorted(keys, own)
    at[at == len(keys)] = 0
    return float(np.where(keys[at] == own, values[at] * times, 0.0).sum())


def gumbel(doc_id: Column, text: Column, seed: int) -> Column:
    """Gumbel noise that a document's id (its text, where it has none) and the seed decide."""
    bits = F.shiftrightunsigned(F.coalesce(F.xxhash64(F.lit(seed), doc_id), F.xxhash64(F.lit(seed), text)), 11)
    return -F.log(-F.log((bits + 0.5) / F.lit(float(1 << 53))))


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight below which documents are rejected: most bad less COST times the good. No example of either: minus infinity.

    Halfway to the next lower weight, so that rounding decides nothing.
    """
    if not len(good) or not len(bad):
        return -np.inf
    cuts = np.unique(np.concatenate([good, bad]))
    gain = np.searchsorted(np.sort(bad), cuts) / len(bad) - COST * np.searchsorted(np.sort(good), cuts) / len(good)
    if gain.max() <= 0:
        return -np.inf
    best = int(gain.argmax())
    return float(cuts[best] + cuts[max(best - 1, 0)]) / 2


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest of column ``key`` (k from 1), exactly, by histograms of ever smaller spans; only bin counts reach the driver."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    while low < high:
        step = (high - low) / bins
        if step <= 0 or low + step == low:
            break
        inside = keys.where(F.col("key").between(low, high))
        counts = {r["bin"]: (r["n"], r["least"], r["most"]) for r in inside.groupBy(F.least(F.floor((F.col("key") - low) / step), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).collect()}
        for b in sorted(counts, reverse=True):
            n, least, most = counts[b]
            if k <= n:
                low, high = least, most
                break
            k -= n
    return low


def resample(docs: DataFrame, labels: DataFrame, *, seed: int = 7, text: bool = True) -> DataFrame:
    """The rows of ``docs`` that the sample keeps, with their columns (but for ``text`` where that isn't asked for), ``log_weight`` and ``key``.

    Null text is empty; a text without words weighs one, its log weight being 0. Very long texts are weighed
    as a whole, in memory of their own size. Repeated rows have equal keys and stay or go
    together; rows tied at the k-th key all stay. Without labels, or where labels tell nothing apart, all
    rows stay. Columns named log_weight and key are replaced. Gathered are at most LABELLED labelled ids and the
    ratios that aren't one, whose number grows with the corpus; they are sent out in blocks of BLOCK.
    """
    sent_out = docs.sparkSession.sparkContext.broadcast
    sample = stored(labelled_sample(labels), "labels", LABELLED)
    bits = pair_bits(docs.count())
    keys, values = log_ratios(docs, sample, bits)
    rows, weight = docs.drop("log_weight", "key"), F.lit(0.0)
    rows = rows.withColumn(noise := fresh(rows, "noise"), gumbel(F.col("doc_id"), F.col("text"), seed))
    blocks = range(0, len(keys), BLOCK)
    for number, at in enumerate(blocks):
        sent = sent_out((keys[at : at + BLOCK], values[at : at + BLOCK]))

        def weigh(texts, sent=sent):
            return [[likelihood_ratio(t or "", bits, *sent.value) for t in texts]]

        last = number == len(blocks) - 1
        rows = annotate(rows, ["text"], [(part := fresh(rows, "part"), T.DoubleType())], weigh, drop=() if text or not last else ("text",))
        weight = weight + F.col(part)
    rest = [c for c in docs.columns if c.lower() not in ("log_weight", "key") and (text or c != "text")]
    scored = rows.withColumn("log_weight", weight).withColumn("key", F.col("log_weight") + TEMPERATURE * F.col(noise))
    scored = stored(scored.select(*[F.col(f"`{c}`") for c in rest], "log_weight", "key"), "scored")
    known = scored.select("doc_id", "log_weight").join(F.broadcast(sample.where("role > 1")), F.col("doc_id") == F.col("id")).select("role", "log_weight").toArrow()
    role, weights = known["role"].to_numpy(), known["log_weight"].to_numpy()
    cut = best_cut(weights[role == 2], weights[role == 3])
    if not np.isfinite(cut):
        return scored
    k = scored.where(F.col("log_weight") >= cut).count()
    least = kth_largest(scored.select("key"), k) if k else np.inf
    return scored.where(F.col("key") >= F.lit(float(least)))
