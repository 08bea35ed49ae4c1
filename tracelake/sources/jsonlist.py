"""Elements of large JSON files that are one list (or an object that holds one under a key), read in ranges of bytes by many tasks.

Where a range begins, it isn't known whether that is inside of a string, nor how deep. So a first scan sums up each
range: whether it turns inside into outside (an odd number of quotes), and by how much it changes the depth in either case. Such
sums add up along a file; then each range knows how it begins, and a second scan cuts the elements that begin in it,
reading on past its end for the last one. Files are read by URI through pyarrow's file systems (local, hdfs, s3, gs).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators.tables import shared_table
from tracelake.sources.tail import place

RANGE = 16 << 20
PACKED = r"\.(gz|bz2|zst|deflate|lz4|snappy)$"


def brackets(data: bytes, odd: bool, inside: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets outside of strings, +1 or -1 for each, and the number of quotes that count.

    ``odd`` says whether an odd run of backslashes stands before ``data``, ``inside`` whether it begins in a string.
    """
    b = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(b == 34)
    drop = []
    for n in np.flatnonzero(b[np.maximum(quotes - 1, 0)] == 92) if len(quotes) else []:
        at = run = int(quotes[n])
        while run > 0 and data[run - 1] == 92:
            run -= 1
        if (at - run + (odd if run == 0 else 0)) % 2:
            drop.append(n)
    if odd and len(quotes) and quotes[0] == 0:
        drop.append(0)
    quotes = np.delete(quotes, sorted(set(drop)))
    found = np.flatnonzero((b | 32 | 6) == 127)  # [ ] { } and a few letters more
    found = found[np.isin(b[found], (91, 93, 123, 125))]
    found = found[(np.searchsorted(quotes, found) % 2 == 1) == inside]
    return found, np.where(np.isin(b[found], (91, 123)), 1, -1), len(quotes)


def _odd(file, start: int) -> bool:
    """Whether an odd run of backslashes ends before a place."""
    run = 0
    while start - run > 0 and file.read_at(1, start - run - 1) == b"\\":
        run += 1
    return run % 2 == 1


def _summary(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for r in frame.itertuples():
            store, path = place(r.path)
            with store.open_input_file(path) as file:
                data, odd = file.read_at(r.stop - r.start, r.start), _odd(file, r.start)
                _, out_of, n = brackets(data, odd, False)
                _, within, _ = brackets(data, odd, True)
                out.append((r.path, r.start, r.stop, n % 2, int(out_of.sum()), int(within.sum()), data.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("latin-1")))
        yield pd.DataFrame(out, columns=["path", "start", "stop", "turns", "d0", "d1", "first"])


def _keys(key: str):
    """(path, at, opens): where the list of the key begins, and where lists end, one level below an object's."""
    before = re.compile(rb'(?<!\\)"' + re.escape(key.encode()) + rb'"\s*:\s*$')

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                store, path = place(r.path)
                with store.open_input_file(path) as file:
                    data = file.read_at(r.stop - r.start, r.start)
                    at, step, _ = brackets(data, _odd(file, r.start), bool(r.inside))
                    depth = r.depth + np.cumsum(step)
                    for n in np.flatnonzero(((step > 0) & (depth == 2)) | ((step < 0) & (depth == 1))):
                        p = r.start + int(at[n])
                        if step[n] < 0:
                            out.append((r.path, p, False))
                        elif data[at[n]] == 91 and before.search(file.read_at(min(p, 4096), max(0, p - 4096))):
                            out.append((r.path, p, True))
            yield pd.DataFrame(out, columns=["path", "at", "opens"])

    return scan


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The elements that begin in a range, each read to its end; ``level`` is the depth between them, (low, high) the list."""
    for frame in frames:
        for r in frame.itertuples():
            store, path = place(r.path)
            with store.open_input_file(path) as file:
                size, start, inside, depth, begin, parts, out = file.size(), r.start, bool(r.inside), int(r.depth), None, [], []
                while start < size and (start < r.stop or begin is not None):
                    stop = r.stop if start < r.stop else min(size, start + (1 << 20))
                    data = file.read_at(stop - start, start)
                    at, step, n = brackets(data, _odd(file, start), inside)
                    after = depth + np.cumsum(step)
                    from_ = 0
                    for k in np.flatnonzero(((step > 0) & (after == r.level + 1)) | ((step < 0) & (after == r.level))):
                        p = int(at[k])
                        if step[k] > 0:
                            if start >= r.stop:
                                break
                            begin, from_, parts = start + p, p, []
                        elif begin is not None:
                            if r.low < begin < r.high:
                                out.append((r.path, begin, (b"".join(parts) + data[from_ : p + 1]).decode("utf-8", "replace")))
                            begin, parts = None, []
                            if start >= r.stop:
                                break
                    if begin is not None:
                        parts.append(data[from_:])
                    inside, depth, start = inside ^ (n % 2 == 1), int(after[-1]) if len(after) else depth, stop
            yield pd.DataFrame(out, columns=["path", "at", "raw"])


def elements(spark: SparkSession, path: str, key: str, size: int = RANGE) -> DataFrame:
    """(path, at, raw): objects and lists that are elements of each file's list, at their byte, in the normal form of Spark's JSON.

    A file that isn't whole (an open string or bracket, an element that is no JSON, neither list nor object) gives nothing, as
    does an object without the key. Compressed files can't be cut and are read whole. What stands between elements isn't looked at.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    plain = files.where(~F.col("path").rlike(PACKED))
    ranges = plain.select("path", F.explode(F.expr(f"sequence(0L, (length - 1) div {size})")).alias("k"), "length").select("path", (F.col("k") * size).alias("start"), F.least((F.col("k") + 1) * size, "length").alias("stop"))
    tasks = max(1, min(ranges.count(), 10_000))
    sums = shared_table(ranges.repartition(tasks, "path", "start").mapInPandas(_summary, "path string, start bigint, stop bigint, turns int, d0 bigint, d1 bigint, first string"), "ranges")
    w = Window.partitionBy("path").orderBy("start")  # a row for each range of a file
    known = sums.withColumn("inside", F.sum("turns").over(w) - F.col("turns")).withColumn("inside", F.col("inside") % 2 == 1)
    change = F.when(F.col("inside"), F.col("d1")).otherwise(F.col("d0"))
    known = known.withColumn("depth", F.sum(change).over(w) - change).withColumn("change", change)
    whole = known.groupBy("path").agg(F.min_by("first", "start").alias("root"), F.sum("change").alias("left"), (F.sum("turns") % 2).alias("open")).where("left = 0 AND open = 0 AND root IN ('[', '{')").select("path", "root")
    known = shared_table(known.join(whole, "path").select("path", "start", "stop", "inside", "depth", "root"), "starts")
    told = known.where("root = '{'").repartition(tasks, "path", "start").mapInPandas(_keys(key), "path string, at bigint, opens boolean")
    opened = told.groupBy("path").agg(F.min(F.when(F.col("opens"), F.col("at"))).alias("low"), F.sort_array(F.collect_list(F.when(~F.col("opens"), F.col("at")))).alias("ends")).where("low IS NOT NULL")
    opened = opened.select("path", "low", F.expr("element_at(filter(ends, e -> e > low), 1)").alias("high"))
    lists = known.where("root = '['").select("path", "start", "stop", "inside", "depth", F.lit(1).alias("level"), F.lit(-1).cast("bigint").alias("low"), F.lit(1 << 62).alias("high"))
    lists = lists.unionByName(known.where("root = '{'").join(opened, "path").where("stop > low AND start < high").select("path", "start", "stop", "inside", "depth", F.lit(2).alias("level"), "low", "high"))
    cut = lists.repartition(tasks, "path", "start").mapInPandas(_cut, "path string, at bigint, raw string")
    normal = shared_table(cut.withColumn("raw", F.element_at(F.from_json(F.concat(F.lit("["), "raw", F.lit("]")), "array<string>"), 1)), "elements")
    found = normal.join(normal.where("raw IS NULL").select("path").distinct(), "path", "left_anti").select("path", "at", "raw")
    if not files.where(F.col("path").rlike(PACKED)).limit(1).count():
        return found
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").where(F.col("path").rlike(PACKED))
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.from_json(F.get_json_object("value", f"$.{key}"), "array<string>"))
    return found.unionByName(texts.select("path", F.posexplode(listed).alias("at", "raw")).withColumn("at", F.col("at").cast("bigint")))
