"""Fill-in-the-middle, word BPE and centroid clustering against brute force and the library, with nulls, ties, repeats and clashing columns."""

import hashlib
import json
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import centroids, infill, word_bpe

DOCS = "doc_id bigint, text string"


# --- fill-in-the-middle ----------------------------------------------------------------------------------------------

def brute_infill(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def infill_rows():
    rng = random.Random(4)
    letters = "ab Z<>PSM\n\t\0.é日🎉𐐀\U0001f469‍"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    return rows + [(400, None), (401, ""), (402, "x<P>"), (403, "<S"), (404, "<M>"), (405, "🎉🎉🎉"), (406, "word " * 60_000), (407, "🎉a" * 30_000), (None, "no id here"), (5, rows[5][1]), (5, rows[5][1])]


def test_infill(spark):
    rows = infill_rows()
    done = infill.fill_in_middle(spark.createDataFrame(rows, DOCS)).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    rows, done = sorted(rows, key=key), sorted(done, key=key)
    assert len(done) == len(rows)
    for (i, text), r in zip(rows, done, strict=True):
        assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (i, *brute_infill(i, text))
        assert r.back == (text or "")
    assert {r.form for r in done} == {"plain", "psm", "spm"}


def test_infill_columns_and_empty_table(spark):
    clash = spark.createDataFrame([(1, "some text to cut")], DOCS).selectExpr("doc_id", "text", "'a' AS N", "'b' AS `__units`", "'c' AS `a.b`", "'d' AS Output", "'e' AS __TEXT")
    done = infill.fill_in_middle(clash)
    assert done.columns == ["doc_id", "text", "__units", "a.b", "__TEXT", "n", "form", "prefix_chars", "middle_chars", "output"]
    r = done.first()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_infill(1, "some text to cut") and r["a.b"] == "c"
    assert infill.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0
    plan = done._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("grammar", [infill.WORDS, infill.RUNS, infill.CHARACTERS, r"[0-9]+|[a-z]+", r"[^\s]+|[\s]+"])
def test_boundaries_are_those_of_the_grammar(spark, grammar):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1 \t.\né🎉\U00010400") for _ in range(rng.randint(0, 25))) for _ in range(150)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", infill.units(F.col("t"), grammar).alias("u"))
    for r in frame.collect():
        assert r.u == [m[0] for m in re.finditer(rf"(?s:{grammar}|.)", r.t)]


def test_grammar_must_be_classes():
    for wrong in ("abc", "[a-z]*", "[a-z]+|", "(a|b)"):
        with pytest.raises(ValueError):
            infill.boundary(wrong)


# --- word BPE --------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def words_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_word_bpe_is_the_library(spark, words_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(words_path)
    rng = random.Random(6)
    pool = [*range(32, 127), *range(0xA0, 0x250), *range(0x300, 0x370), 0x3A3, 0x3C2, 0x130, 0x11935, 0x11930, 0x9FE, 0x7FD, 0xA7CE, 0x16EA0, 0x16EB8, 0x1C89, 0x10D50, 0x088F, 0x323B0, 0x1F389]
    texts = [None, "", " \n\t", "It's THEY'RE 'S ''s don't", "x<|endoftext|>Y <|startoftext|><|ENDOFTEXT|>", "ΑΣ ΣΑΣ. İ", "antidisestablishmentarianism " * 3000, "a" * 40_000, "qzxj" * 5000, "\0\x1c\x85　x", "</w> a</w>"]
    texts += ["".join(chr(rng.choice(pool)) if rng.random() < 0.4 else rng.choice("aeinst hrdl") for _ in range(60)) for _ in range(300)]
    every = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts += ["a".join(map(chr, every[i : i + 4000])) for i in range(0, 0x3000, 4000)]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([*rows, rows[3]], DOCS)
    got = {r.doc_id: r for r in word_bpe.encode_documents(frame, words_path, digests=False).collect()}
    told = {r.doc_id: r for r in word_bpe.encode_documents(frame.selectExpr("doc_id", "text", "'x' AS n_tokens", "'y' AS k0"), words_path).collect()}
    for i, text in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(want, skip_special_tokens=False)
        assert got[i].token_ids == want and got[i].decoded == decoded and got[i].n_tokens == len(want), text
        assert told[i].n_tokens == len(want)
        assert told[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest() and told[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert word_bpe.encode_documents(spark.createDataFrame([], DOCS), words_path).count() == 0


def test_word_bpe_long_texts_and_full_tables(words_path, monkeypatch):
    with open(words_path, "rb") as file:
        data = file.read()
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(3000)) for _ in range(4)]
    codec = word_bpe.Codec(data)
    want = {}
    for k, ids in codec.encode(texts):
        want.setdefault(k, []).extend(ids)
    for name, value in (("MAX_WORDS", 300), ("TOGETHER", 256), ("LONG", 1000)):
        monkeypatch.setattr(word_bpe, name, value)
    small, got = word_bpe.Codec(data), {}
    for k, ids in small.encode(texts):
        got.setdefault(k, []).extend(ids)
    assert got == want and len(small.young) + len(small.old) < 3000
    began = time.time()
    assert sum(len(ids) for _, ids in codec.encode(["xq" * 100_000])) > 0
    assert time.time() - began < 20


def vocabulary(merges):
    shown = word_bpe.byte_characters()
    vocab = {t: i for i, t in enumerate([c + e for e in ("", "</w>") for c in shown])}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    regex = lambda p: {"Regex": p}
    return json.dumps({"added_tokens": [], "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": regex(r"\s+"), "content": " "}, {"type": "Lowercase"}]}, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": regex(r"[\p{L}]+|[^\s\p{L}]"), "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}, "post_processor": None, "decoder": None, "model": {"type": "BPE", "end_of_word_suffix": "</w>", "vocab": vocab, "merges": [list(m) for m in merges]}}).encode()


@pytest.mark.parametrize("seed", range(6))
def test_speculation_is_merging_for_any_merges(seed):
    """Random merges in order, such as no training gives, tokens that several merges make, and (odd seeds) merges before their parts."""
    rng = random.Random(seed)
    inner, last = list("abc"), [c + "</w>" for c in "abc"]
    merges = []
    while len(merges) < 120:
        left, right = rng.choice(inner), rng.choice(inner + last)
        if (left, right) not in merges and len(left + right) < 14:
            merges.append((left, right))
            (last if right.endswith("</w>") else inner).append(left + right)
    if seed % 2:
        rng.shuffle(merges)
    own = word_bpe.Vocabulary(vocabulary(merges))
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    rank = {m: i for i, m in enumerate(merges)}

    def plain(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        while pairs := [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in rank]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    counted = []
    got = own.encode_words(words, counted)
    assert [[own.text_of[t] for t in ids] for ids in got] == [plain(w) for w in words]
    assert seed % 2 or 0 < counted[0] < len(words)


def test_other_vocabularies_are_refused(words_path):
    with open(words_path, "rb") as file:
        spec = json.load(file)
    spec["model"]["unk_token"] = "x"
    with pytest.raises(ValueError):
        word_bpe.Vocabulary(json.dumps(spec).encode())


# --- centroid clustering ---------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute_clusters(rows, count=16, rounds=3, dims=64, scale=64):
    held = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    held = [(i, v) for i, v in held if max(map(abs, v)) < centroids.LARGEST]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(held, key=lambda r: (name(r[0]), r[1]))[:count]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for again in range(rounds + 1):
        near = [min((far(v, c), j) for j, c in enumerate(centres)) for _, v in held]
        if again < rounds:
            for j in range(len(centres)):
                mine = [v for (_, v), (_, k) in zip(held, near, strict=True) if k == j]
                if mine:
                    centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    sums = {j: sum(d for d, k in near if k == j) for j in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, sums[j], sum(sums.values()), sha[j]) for (i, _), (d, j) in zip(held, near, strict=True)), key=repr)


def vector_rows():
    rng = np.random.default_rng(8)
    middle = rng.normal(0, 2, (20, 64))
    rows = [(i, (middle[i % 20] * (i % 3 > 0) + rng.normal(0, 0.4, 64)).astype(np.float32).tolist()) for i in range(400)]
    same = rows[3][1]
    odd = [(500, None), (501, []), (502, same[:-1]), (503, [*same, 0.0]), (504, [None, *same[1:]]), (505, [float("nan"), *same[1:]]), (506, [float("inf"), *same[1:]]), (507, [3e38, *same[1:]]), (None, same)]
    return rows + odd + [(i, same) for i in range(600, 660)] + [rows[7], rows[7]]


def test_clusters_are_brute_force(spark):
    rows = vector_rows()
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(7)
    got = centroids.cluster(frame)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_clusters(rows)


def test_clusters_of_few_equal_and_no_vectors(spark):
    assert centroids.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(i, [0.5] * 64) for i in range(30)] + [(40, [-0.51] * 64), (41, None)]
    for some in (rows, rows[:3], rows[-1:], [(1, [2.0] * 64)] * 5):
        clash = spark.createDataFrame(some, "vec_id bigint, embedding array<double>").selectExpr("vec_id", "embedding", "1 AS cluster", "2 AS v", "3 AS c", "4 AS `a.b`")
        got = centroids.cluster(clash)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_clusters(some)


def test_screen_measures_few_and_loses_none():
    rng = np.random.default_rng(9)
    for size, spread in ((8, 1), (1 << 26, 1000), (3, 0)):
        middle = rng.integers(-size, size + 1, (16, 64)) * (rng.random((16, 1)) < 0.8)
        v = middle[rng.integers(0, 16, 3000)] + rng.integers(-spread, spread + 1, (3000, 64))
        counted = []
        who, far = centroids.nearest(v, centroids.segment_norms(v), middle, centroids.segment_norms(middle), counted)
        exact = ((v[:, None, :] - middle[None]) ** 2).sum(axis=2)
        assert (who == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()
        assert counted[0] >= len(v) and (spread == 0 or counted[0] < 0.9 * exact.size)
