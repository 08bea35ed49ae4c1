"""Line deduplication from DataFrame functions alone.

Keys of lines become 128-bit hashes, stored once. They are range-partitioned by (hash, cell) and sorted
within by hash, cell and document, the last document first; windows then stream down each partition's
sorted rows and tell, for each row, its document's place among those that hold the hash and how many
there are. The cell of a hash is 0, but for the few hashes so frequent that they would fill a partition by
themselves: their documents are dealt over as many cells as they take, and what the cells have seen - their
number of documents and the last of them - is put together in a small table of such edges. Lines that go come
back to their documents as sparse bitmaps; text isn't shuffled while the bitmaps are small enough to be sent to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import ASCII_SPACE, ascii_lower, discard, fresh, stored

WORD = 63
#: Frequent hashes are looked for among one in THIN rows, where there are more than that many times FEW.
THIN, FEW = 16, 20_000
#: Words of bitmaps that are sent to the documents (up to about 60 MB); more meet them in a shuffle.
SENT = 1 << 19


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """(h1, h2, doc_id, pos) of lines whose key has at least ``least`` code points."""
    lines = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
    # a key is never longer than its line, so short lines need no key
    keys = lines.where(F.char_length("line") >= least).select("doc_id", "pos", F.btrim("line", F.lit(ASCII_SPACE)).alias("bare")).where(F.char_length("bare") >= least).select("doc_id", "pos", ascii_lower(F.col("bare")).alias("key"))
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "pos")


def dropped_lines(docs: DataFrame, least: int, documents: int) -> DataFrame:
    """(doc_id, pos) of the lines that go."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = stored(line_hashes(docs, least), "line-hashes")
    total = entries.count()
    # which hashes are frequent decides how rows are dealt out and nothing else, so a thinned count is enough
    thin = THIN if total > THIN * FEW else 1
    room = max(1000, total // (2 * parts))
    some = entries.where(F.pmod(F.xxhash64("doc_id", "pos"), F.lit(thin)) == 0).groupBy("h1", "h2").agg((F.count("*") * thin).alias("rows"))
    hot = stored(some.where(F.col("rows") >= room).select("h1", "h2", F.ceil(F.col("rows") * 2 / room).alias("cells")), "frequent", 2 * parts)
    # there are at most about 2 * parts of them
    dealt = entries.join(F.broadcast(hot), ["h1", "h2"], "left")
    # (the cell 0 is written as a value of the row: a constant would be taken out of the range partitioning, and the windows would shuffle again)
    cell = F.coalesce(F.pmod(F.xxhash64("doc_id"), "cells"), F.least("pos", F.lit(0)).cast("bigint"))
    dealt = dealt.select("h1", "h2", F.col("cells").isNotNull().alias("hot"), cell.alias("cell"), "doc_id", "pos")
    run = Window.partitionBy("h1", "h2", "cell")
    streamed = dealt.repartitionByRange(parts, "h1", "h2", "cell").withColumn("place", F.dense_rank().over(run.orderBy(F.desc("doc_id")))).withColumn("n", F.max("place").over(run))
    seen = stored(streamed.where("hot OR n > 1"), "repeated-lines", total, busy=True)
    discard(entries, hot)
    cold = seen.where(~F.col("hot") & (F.col("place") > 1) & (F.col("n") >= documents))
    edges = seen.where("hot AND place = 1").groupBy("h1", "h2", "cell").agg(F.max("n").alias("n"), F.max("doc_id").alias("last"))
    edges = edges.groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.max("last").alias("last")).where(F.col("total") >= documents)
    over = seen.where("hot").join(F.broadcast(edges), ["h1", "h2"]).where(F.col("doc_id") < F.col("last"))
    return cold.select("doc_id", "pos").unionByName(over.select("doc_id", "pos"))


def drop_bitmaps(docs: DataFrame, least: int = 20, documents: int = 3) -> DataFrame:
    """(doc_id, dropped): which lines go, as a sparse map from word number to 63 bits; documents that lose none have no row."""
    gone = dropped_lines(docs, least, documents)
    words = gone.groupBy("doc_id", F.expr(f"pos div {WORD}").cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD})")).alias("bits"))
    return words.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "bits")))).alias("dropped"))


def dedup_lines(docs: DataFrame, least: int = 20, documents: int = 3) -> DataFrame:
    """``docs`` with ``kept`` (text of the lines that stay), ``n_lines``, ``n_dropped`` and the bitmap ``dropped``.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of at
    least ``least`` code points that at least ``documents`` documents hold lose all their lines but those
    in the largest doc_id. Null or empty text is one empty line and is kept as the empty text. Rows with
    a null doc_id keep all lines and count for no key; rows that repeat a doc_id count as one document,
    and a line goes from all of them where it goes from one position of that id. A very long text is one row of
    its lines' hashes each and one bitmap. Other columns pass, but for those of the four names made here.
    """
    docs = docs.drop("dropped", "kept", "n_lines", "n_dropped")
    key, lines, left = (fresh(docs, name) for name in ("marked", "lines", "left"))
    marks = stored(drop_bitmaps(docs, least, documents), "bitmaps", docs.count())
    small = (marks.agg(F.sum(F.size("dropped") + 1)).first()[0] or 0) <= SENT
    marks = marks.withColumnRenamed("doc_id", key)
    joined = docs.join(F.broadcast(marks) if small else marks, docs.doc_id == marks[key], "left").drop(key).withColumn(lines, text_lines(F.col("text")))
    stays = F.expr(f"filter(`{lines}`, (line, i) -> shiftright(coalesce(dropped[cast(i div {WORD} as int)], 0L), i % {WORD}) & 1L = 0)")
    kept = F.when(F.col("dropped").isNull(), F.col(lines)).otherwise(stays)
    return (
        joined.withColumn(left, kept)
        .withColumn("kept", F.array_join(left, "\n"))
        .withColumn("n_lines", F.size(lines).cast("bigint"))
        .withColumn("n_dropped", (F.size(lines) - F.size(left)).cast("bigint"))
        .drop(lines, left)
    )
