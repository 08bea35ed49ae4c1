"""The pipeline and its queries against a brute-force version on a small folder of tables."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import DOCS, brute_components, brute_fingerprint, brute_lines, brute_weights
from tracelake.llm import bpe, decontaminate, quality, queries, similar


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{i}" for i in range(150)]
    words = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, words(25)) for i in range(6)]
    shared = [words(8) + " a line that repeats" for _ in range(4)]
    rows = []
    for i in range(300):
        text = "\n".join(words(20) for _ in range(4))
        if i % 7 == 0:
            text += "\n" + rng.choice(shared)
        if i % 11 == 0:
            text = text.replace("\n", f"\n{rng.choice(items)[1]}\n", 1)
        if i % 6 == 0:
            text += " scum idiot trash"
        if i % 13 == 0 and i:
            text = rows[i // 2][1]
        rows.append((i, text, "en", "s", len(text)))
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (None, "no id here at all", "en", "s", 17)]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(0, 300, 2)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, labels, items


def brute_quality(spark, rows, labels):
    kind = {i: q == 1 and t == 0 for i, q, t in labels}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    weight = brute_weights([r[:2] for r in rows], {i for i, good in kind.items() if good and not held(i)})
    good = [w for r, w in zip(rows, weight, strict=True) if kind.get(r[0]) and held(r[0])]
    bad = [w for r, w in zip(rows, weight, strict=True) if kind.get(r[0]) is False]
    gain, cut = max((sum(b < c for b in bad) / len(bad) - 4.0 * sum(g < c for g in good) / len(good), -c) for c in {*good, *bad})
    cut = -cut
    assert gain > 0
    cut = (cut + max((w for w in good + bad if w < cut), default=cut)) / 2
    k = sum(w >= cut for w in weight)
    noise = [r.g for r in spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "n int, doc_id bigint, text string").select("n", quality.gumbel(F.col("doc_id"), F.col("text"), 7).alias("g")).orderBy("n").collect()]
    keys = [w + 0.25 * g for w, g in zip(weight, noise, strict=True)]
    least = sorted(keys, reverse=True)[k - 1]
    return [r for r, key in zip(rows, keys, strict=True) if key >= least - 1e-9]


def brute_pipeline(spark, rows, labels, items):
    rows = brute_quality(spark, rows, labels)
    named = brute_lines([(r[0], r[1]) for r in rows if r[0] is not None])
    rows = [(r[0], r[1] if r[0] is None or not named[r[0]][1] else named[r[0]][2], *r[2:4], r[4] if r[0] is None or not named[r[0]][1] else len(named[r[0]][2])) for r in rows]
    label = brute_components({r[0]: brute_fingerprint(r[1]) for r in rows if r[0] is not None})
    rows = [r for r in rows if r[0] is None or label[r[0]] == r[0]]
    index = decontaminate.Index(items)
    return [r for r in rows if not decontaminate.passages(r[1] or "", index)]


def test_pipeline(spark, folder):
    path, rows, labels, items = folder
    want = brute_pipeline(spark, rows, labels, items)
    done = corpus_pipeline.run(spark, path)
    got = {r.doc_id: r for r in done.collect()}
    assert set(got) == {r[0] for r in want} and len(want) < len(rows) and None in got
    import public_tokenizers as P

    codec = bpe.Codec(bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    for r in want:
        assert got[r[0]].n_tokens == len(codec.encode(r[1] or "")) // 4 and got[r[0]].n_chars == r[4]


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.withColumn("kept", F.lit(1)).where("false"), path)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS and out.count() == 0, name


def test_rows_that_repeat_an_id_count_once(spark, folder):
    docs = spark.createDataFrame([(1, "a b c d e", "en", "s", 9), (1, "a b c d e", "en", "s", 9), (2, "f g h i", "en", "s", 7), (None, "x", None, None, 1)], DOCS)
    got = corpus_pipeline.near_duplicates_stage(spark, docs, folder[0]).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2]


def test_every_operator_is_registered():
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} and set(queries.oracle_sql()) <= set(names)


def similar_texts(rng, n):
    """Texts and near copies: of one family each, with some words replaced."""
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 300))]
        out.append(" ".join(words))
        for changes in range(1, 4):
            copy = list(words)
            for _ in range(max(1, changes * len(words) // 160)):
                copy[rng.randrange(len(copy))] = "new"
            out.append(" ".join(copy))
    return out


def test_near_duplicates_are_the_similar_texts(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = similar_texts(rng, 40) + ["", " ", "a b c", "A  b c", "x y z"]
    base = [f"v{i}" for i in range(120)]
    texts += [" ".join(base[:i] + ["odd"] + base[i + 1 :]) for i in range(0, 120, 2)]
    texts += [f"{passage} " + " ".join(rng.choice(base) for _ in range(60)) for _ in range(30)]
    sets = [similar.shingles(t, 5) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    far = 0
    for i in range(len(texts)):
        for j in range(i):
            if similar.similarity(sets[i], sets[j]) >= 0.8:
                far += (brute_fingerprint(texts[i], 4) ^ brute_fingerprint(texts[j], 4)).bit_count() > 4
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert far > 50  # what four bits of four-word shingles do not link
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in similar.groups(docs).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
