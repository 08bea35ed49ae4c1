"""Groups of documents whose word shingles are similar, exactly: nothing at or over the threshold is missed.

Equal word sequences are one class. Two classes are linked where the Jaccard similarity of their sets
of word shingles, counted on the words themselves, is at least the threshold. Candidates come from two
sides: SimHash fingerprints within a few bits of each other by multi-index hashing, and, for what is
further apart, the prefix filter: under any one order of all shingles, two sets of similarity s share
one among the first n - ceil(s * n) + 1 of each. The order is by hash, shingles that a sample shows to
be common coming last, so that a passage which many documents hold meets few of them.

Before texts meet, sketches do: bit i of a sketch is the parity of the number of a document's shingles whose hash
falls into bin i of SKETCH. Bits that differ are bins in which the two sets differ, so there are no more of
them than shingles in which the sets differ, and a pair with more than its similarity allows is none. Pairs that
are left meet once more by the counts of their shingles in as many bins as suit their size, in the same way.

A group of n near copies costs no n * n pairs: first the members of each shared shingle are compared
with one of them, another for each shingle, and then only pairs that are not yet in one group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import simhash
from tracelake.llm.common import discard, sent_if_small, spread_join, stored, tidy
from tracelake.llm.components import components

#: Documents in which common shingles are looked for, and in how many of them a shingle is common. Decides the order only.
SAMPLE, COMMON = 4000, 8
#: Bits of a sketch, in words of 64.
SKETCH = 512
#: Rows of shingles or texts in one Arrow batch.
CHUNK = 50_000


def shingles(text: str, words: int) -> set[bytes]:
    """The word shingles of a text; one of fewer words is one shingle, and none has none."""
    parts = text.encode().lower().split()
    if len(parts) <= words:
        return {b" ".join(parts)} if parts else set()
    return {b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)}


def hashed(text: str, words: int) -> np.ndarray:
    found = shingles(text, words)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))


def prefix_size(n: int, threshold: float) -> int:
    """How many of the first of n shingles hold one of any set of that similarity."""
    return n - math.ceil(threshold * n - 1e-9) + 1 if n else 0


def sketch(keys: np.ndarray) -> np.ndarray:
    """Parities of the numbers of hashes in the bins, as SKETCH / 64 signed words."""
    bins = keys >> np.uint64(64 - (SKETCH - 1).bit_length())
    return np.packbits(np.bincount(bins.astype(np.int64), minlength=SKETCH) & 1 == 1).view(">i8").astype(np.int64)


def bins(keys: np.ndarray) -> bytes:
    """Numbers of hashes in the bins: a power of two of them, about one for four hashes, at least 64."""
    width = max(6, (len(keys) // 4).bit_length())
    return np.bincount((keys >> np.uint64(64 - width)).astype(np.int64), minlength=1 << width).astype("<u4").tobytes()


def least_apart(one: bytes, other: bytes) -> tuple[int, int]:
    """In how many shingles two sets differ at least, by their bins, and how many both have together."""
    a, b = sorted((np.frombuffer(x, "<u4").astype(np.int64) for x in (one, other)), key=len)
    folded = b.reshape(len(a), -1).sum(1)
    return int(np.abs(a - folded).sum()), int(a.sum() + b.sum())


def alike(one: str, other: str, na, nb, threshold: float):
    """Whether the sketches in two columns allow the similarity of sets of na and nb shingles."""
    apart = sum((F.bit_count(F.get(one, F.lit(k)).bitwiseXOR(F.get(other, F.lit(k)))) for k in range(SKETCH // 64)), F.lit(0))
    return apart <= (na + nb) * ((1 - threshold) / (1 + threshold)) + 1e-6


def similarity(a: set[bytes], b: set[bytes]) -> float:
    shared = len(a & b)
    return shared / (len(a) + len(b) - shared) if a or b else 1.0


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Hashes of shingles that at least COMMON of SAMPLE documents hold, sorted."""
    some = docs.orderBy(F.xxhash64("id"), "id").limit(SAMPLE)

    def run(batches):
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(hashed(text.as_py(), words).view(np.int64), pa.int64())], names=["key"])

    held = some.select("text").mapInArrow(tidy(run), "key bigint").groupBy("key").count().where(F.col("count") >= COMMON).select("key").toArrow()
    return np.sort(held["key"].to_numpy().view(np.uint64))


def prefixes(docs: DataFrame, common: np.ndarray, words: int, threshold: float) -> DataFrame:
    """(key, id, n, pos): the first shingles of each document; n is the number of all, pos the place from 0."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        late = sent.value
        for batch in batches:
            ids, ns, keys = [], [], []

            def flush():
                sizes = [len(k) for k in keys]
                places = np.concatenate([np.arange(s) for s in sizes])
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(ids, sizes), pa.int64()), pa.array(np.repeat(ns, sizes), pa.int32()), pa.array(places, pa.int32())], names=["key", "id", "n", "pos"])

            held = 0
            for own_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = hashed(text.as_py(), words)
                if not len(own):
                    continue
                if len(late):
                    is_late = np.isin(own, late)
                    own = np.concatenate([own[~is_late], own[is_late]])
                ids.append(own_id)
                ns.append(len(own))
                keys.append(own[: prefix_size(len(own), threshold)])
                held += len(keys[-1])
                if held > CHUNK:
                    yield flush()
                    ids, ns, keys, held = [], [], [], 0
            if held:
                yield flush()

    return docs.select("id", "text").mapInArrow(tidy(run), "key bigint, id bigint, n int, pos int")


def verified(pairs: DataFrame, docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts are similar, by their words. Only texts that are in a pair are dealt out."""
    within = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    docs = docs.join(sent_if_small(within), "id", "left_semi")
    first = pairs.join(docs, F.col("a") == F.col("id")).select("a", "b", F.col("text").alias("x"))
    both = first.join(docs, F.col("b") == F.col("id")).select("a", "b", "x", F.col("text").alias("y"))

    def run(batches):
        for batch in batches:
            last, own = None, set()
            keep = []
            for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, own = a, shingles(x.as_py(), words)
                keep.append(similarity(own, shingles(y.as_py(), words)) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(tidy(run), "a bigint, b bigint")


def sifted(pairs: DataFrame, counted: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose bins, in ``counted`` (id, bins), allow the similarity."""
    first = pairs.join(counted.select(F.col("id").alias("a"), F.col("bins").alias("x")), "a")
    both = first.join(counted.select(F.col("id").alias("b"), F.col("bins").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                apart, size = least_apart(x.as_buffer(), y.as_buffer())
                keep.append(apart <= size * (1 - threshold) / (1 + threshold) + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(tidy(run), "a bigint, b bigint")


def possible(met: DataFrame, threshold: float) -> DataFrame:
    """Of rows (a, b, na, nb, pa, pb), one a shared prefix shingle, the pairs that can still be similar.

    Similar sets differ in at most (na + nb) * (1 - s) / (1 + s) shingles. Up to the last shared place all
    shingles of both are known, and of the set whose prefix ends first all of its prefix.
    """
    whole = lambda n: F.col(n) - F.ceil(threshold * F.col(n) - 1e-9) + 1
    counted = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    apart = F.least(whole("na") + F.col("pb") + 1, F.col("pa") + 1 + whole("nb")) - 2 * F.col("c")
    return counted.where(apart <= (F.col("na") + F.col("nb")) * ((1 - threshold) / (1 + threshold)) + 1e-6).select("a", "b")


def groups(docs: DataFrame, *, words: int = 5, threshold: float = 0.8, distance: int = 4) -> DataFrame:
    """(doc_id, component_id) of each row with a doc_id: the least doc_id of its group.

    Null text is empty, and texts without words are one group. Repeated rows give repeated rows.
    """
    known = docs.where("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def name(text: str) -> int:
        return xxhash.xxh64_intdigest(b" ".join(text.encode().lower().split()), 1)

    def named(batches):
        for batch in batches:
            found = np.array([name(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "text", "id"])

    def printed(batches):
        for batch in batches:
            prints, sketches, numbers = [], [], []
            for t in batch.column(1):
                prints.append(simhash.fingerprint(t.as_py(), words))
                keys = hashed(t.as_py(), words)
                sketches.append(sketch(keys))
                numbers.append(bins(keys))
            found = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(sketches, pa.list_(pa.int64())), pa.array(numbers, pa.binary())], names=["id", "f", "sketch", "bins"])

    # equal word sequences are one class, whose text is that of its least document
    rows = known.mapInArrow(tidy(named), "doc_id bigint, text string, id bigint")
    total = known.count()
    ids = stored(rows.select("doc_id", "id"), "ids")
    classes = stored(ids.groupBy("id").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes", total)
    copies = stored(spread_join(ids, classes, ["id"], "n", total).where("doc_id <> least").select("doc_id", "id"), "copies", total)
    texts = stored(rows.join(sent_if_small(copies.distinct()), ["doc_id", "id"], "left_anti").select("id", "text"), "texts")
    discard(copies)
    entries = stored(prefixes(texts, common_shingles(texts, words), words, threshold), "prefixes")
    n_entries = entries.count()
    held = stored(entries.groupBy("key").agg(F.count("*").alias("m"), F.min_by("id", F.xxhash64("key", "id")).alias("lead")).where("m > 1"), "held", n_entries // 2)
    shared = stored(spread_join(entries, held, ["key"], "m", n_entries), "shared", held.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0])
    n_shared = shared.count()
    discard(entries)

    # pairs by SimHash: of each class with the first of its fingerprint, and of the first of near fingerprints
    prints = stored(texts.mapInArrow(tidy(printed), "id bigint, f bigint, sketch array<bigint>, bins binary"), "fingerprints")
    n_prints = prints.count()
    lowest = stored(prints.groupBy("f").agg(F.min("id").alias("low"), F.count("*").alias("n")), "lowest", total)
    equal = spread_join(prints.select("id", "f"), lowest, ["f"], "n", n_prints).select(F.col("low").alias("a"), F.col("id").alias("b"))
    la, lb = lowest.select(F.col("f").alias("a"), F.col("low").alias("la")), lowest.select(F.col("f").alias("b"), F.col("low").alias("lb"))
    near = simhash.links(lowest.select("f"), distance).join(la, "a").join(lb, "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
    # and of each member of a shared shingle with one that a hash of both chooses, another for each shingle
    sketched = stored(shared.join(prints.select("id", "sketch").dropDuplicates(["id"]), "id"), "sketched", 4 * n_shared)
    discard(shared)
    leads = sketched.where("id = lead").select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("sketch").alias("sa"))
    members = sketched.where("id <> lead").select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("sketch").alias("sb"))
    led = spread_join(members, leads.join(held.select("key", "m"), "key"), ["key"], "m", n_entries).where(alike("sa", "sb", F.col("na"), F.col("nb"), threshold))
    led = led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    candidates = stored(near.union(equal).union(led).where("a <> b").distinct(), "candidates", 2 * n_shared + total)
    n_candidates = candidates.count()
    discard(lowest, held)
    counted = prints.select("id", "bins").dropDuplicates(["id"])
    links = stored(verified(stored(sifted(candidates, counted, threshold), "sifted", n_candidates, busy=True), texts, words, threshold), "links", n_candidates, busy=True)
    discard(candidates)
    label = stored(components(links), "labels", 2 * n_candidates)

    # then all pairs of a shared shingle that are not in one group yet and whose sketches allow it
    own = sketched.select("key", "id", "n", "pos", "sketch").join(sent_if_small(label), F.col("id") == F.col("node"), "left").select("key", "id", "n", "pos", "sketch", F.coalesce("root", "id").alias("root"))
    mixed = own.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    left = stored(own.join(mixed, "key", "left_semi"), "mixed", 4 * n_shared)
    discard(sketched, label)
    one = left.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("root").alias("ra"), F.col("sketch").alias("sa"))
    other = left.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("root").alias("rb"), F.col("sketch").alias("sb"))
    sized = (F.col("na") >= threshold * F.col("nb") - 1e-6) & (F.col("nb") >= threshold * F.col("na") - 1e-6)
    apart = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & sized & alike("sa", "sb", F.col("na"), F.col("nb"), threshold)
    met = one.join(other.withColumnRenamed("key", "key_b"), (F.col("key") == F.col("key_b")) & apart)
    pairs = stored(possible(met, threshold), "candidates", 2 * n_shared)
    discard(left)
    n_pairs = pairs.count()
    more = stored(verified(stored(sifted(pairs, counted, threshold), "sifted", n_pairs, busy=True), texts, words, threshold), "links", n_pairs, busy=True)
    discard(pairs, texts, prints)
    found = stored(components(links.union(more)), "components", 2 * total)
    low = stored(found.join(classes, found.node == classes.id).groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")), "lowest", total)
    linked = spread_join(found, low, ["root"], "size", found.count()).select(F.col("node").alias("id"), "component_id")
    final = stored(classes.join(linked, "id", "left").select("id", "n", F.coalesce("component_id", "least").alias("component_id")), "classes", total)
    discard(links, more, found, low, classes)
    return spread_join(ids, final, ["id"], "n", total).select("doc_id", "component_id")
