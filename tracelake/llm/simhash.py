"""SimHash near-duplicates by multi-index hashing.

Fingerprints are cut into segments. If two differ in at most r bits, then, with r = m*s + t over m
segments, one of the first t + 1 segments differs in at most s bits or one of the others in at most
s - 1. So each fingerprint looks up, in the table of each segment, every value in that small Hamming
ball around its own segment; what it meets is verified over all bits within the join. Equal
fingerprints are one entry with a count, so groups of copies cost one row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import spread_join, stored, tidy
from tracelake.llm.components import components

SEED = 42


def fingerprint(text: str, words: int = 4) -> int:
    """64 bits: those set in more than half of the XXH64 of the word shingles; 0 without words."""
    parts = text.encode().lower().split()  # of bytes: both know ASCII only
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts = [0, *ends[:-1].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=False)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(np.array(hashes[at : at + (1 << 15)], ">u8").view(np.uint8))
        total += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, f): f is the fingerprint as a signed long. Null text counts as empty."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(value.as_py(), words) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())], names=["doc_id", "f"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(tidy(run), "doc_id bigint, f bigint")


def segments(bits: int, distance: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of ``bits`` segments."""
    least, over = divmod(distance, bits)
    out, shift = [], 0
    for k in range(bits):
        width = 64 // bits + (k < 64 % bits)
        out.append((shift, width, least if k <= over else least - 1))
        shift += width
    return [s for s in out if s[2] >= 0]


def links(distinct: DataFrame, distance: int = 4, parts: int = 3) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints ``f`` that differ in at most ``distance`` bits.

    ``parts``: the number of segments. Wide segments meet fewer strangers and need larger balls; three
    (22, 21 and 21 bits, 46 look-ups) suit up to about 10^8 fingerprints, two (32 bits, 562 look-ups) more.
    """
    spans = segments(parts, distance)

    def value(shift: int, width: int):
        return F.shiftrightunsigned("f", shift).bitwiseAND(F.lit((1 << width) - 1))

    def entry(k: int, key):
        return F.struct(F.lit(k).alias("part"), key.alias("key"))

    def ball(k: int, shift: int, width: int, radius: int):
        flips = [sum(1 << i for i in c) for n in range(radius + 1) for c in combinations(range(width), n)]
        return F.transform(F.array(*[F.lit(x).cast("bigint") for x in flips]), lambda x: entry(k, value(shift, width).bitwiseXOR(x)))

    made = distinct.select(F.col("f").alias("b"), F.explode(F.array(*[entry(k, value(s, w)) for k, (s, w, _) in enumerate(spans)])).alias("e")).select("b", F.col("e.part").alias("b_part"), F.col("e.key").alias("b_key"))
    asked = distinct.select(F.col("f").alias("a"), F.explode(F.concat(*[ball(k, *span) for k, span in enumerate(spans)])).alias("e")).select("a", "e.part", "e.key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    # both ends look each other up, so the order of the ends drops nothing
    return asked.join(made, [F.col("part") == F.col("b_part"), F.col("key") == F.col("b_key"), F.col("a") < F.col("b"), near]).select("a", "b").distinct()


#: Up to so many fingerprints three segments meet few strangers; beyond, two are used.
THREE = 1 << 24


def near_duplicates(docs: DataFrame, *, words: int = 4, distance: int = 4, parts: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, f (signed long), component_id.

    component_id is the smallest doc_id reachable over links, the row's own included. Texts without words
    have fingerprint zero and are linked like any other; null text is empty. A null doc_id has a row, and
    its text takes part in linking; it is never a component_id unless its whole component has no id. A text's
    hashes are summed in pieces, so a very long one needs no more memory than its words. Ties of a bit (set in
    exactly half the shingles) are 0. ``parts`` is chosen from the number of different fingerprints. Repeated rows give repeated rows; no rows give none; other columns are left aside.
    """
    total = docs.count()
    prints = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(prints.groupBy("f").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes", total)
    parts = parts or (3 if distinct.count() <= THREE else 2)
    joined = stored(links(distinct.select("f"), distance, parts), "pairs", 50 * total)
    found = stored(components(joined), "components", total)
    lowest = stored(found.join(distinct, found.node == distinct.f).groupBy("root").agg(F.min("least").alias("low"), F.count("*").alias("size")), "lowest", total)
    linked = spread_join(found, lowest, ["root"], "size", found.count()).select(F.col("node").alias("f"), "low")
    classes = stored(distinct.join(linked, "f", "left").select("f", F.coalesce("low", "least").alias("component_id"), "n"), "classes", total)
    return spread_join(prints, classes, ["f"], "n", total).select("doc_id", "f", "component_id")
