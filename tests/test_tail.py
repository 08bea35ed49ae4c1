"""The tail source: appended, truncated, replaced, renamed and removed files, long spans, and the stream over it."""

import os
import random

from tests.test_sources import assistant, user
from tracelake.sources.tail import TailReader
from tracelake.streaming import capture


class Tail:
    """Batches of a reader as the engine asks for them."""

    def __init__(self, folder, span=None):
        self.options = {"path": str(folder)} | ({"spanBytes": str(span)} if span else {})
        self.at = TailReader(self.options).initialOffset()

    def batch(self, reader=None):
        reader = reader or TailReader(self.options)
        to = reader.latestOffset()
        self.spans = reader.partitions(self.at, to)
        self.at = to
        return [(os.path.basename(p), line) for s in self.spans for p, _, line in reader.read(s)]


def test_identity_of_files(tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    tail = Tail(tmp_path)
    assert tail.batch() == []
    a.write_text("one\ntwo\nthr")
    assert tail.batch() == [("a.jsonl", "one"), ("a.jsonl", "two")] and tail.batch() == []
    a.open("a").write("ee\n\n")
    assert tail.batch() == [("a.jsonl", "three")]
    a.write_text("one\n")  # truncated: shorter than before
    assert tail.batch() == [("a.jsonl", "one")]
    a.write_text("")
    assert tail.batch() == []
    a.write_text("one\nnew and longer than what was there\n")
    assert [x for _, x in tail.batch()] == ["one", "new and longer than what was there"]
    (tmp_path / "tmp").write_text("another\nfile of just as many bytes or more, put in its place\n")
    os.replace(tmp_path / "tmp", a)  # replaced by another that is longer
    assert [x for _, x in tail.batch()] == ["another", "file of just as many bytes or more, put in its place"]
    a.rename(b)
    assert tail.batch() == []
    b.open("a").write("after\n")
    assert tail.batch() == [("b.jsonl", "after")]
    b.rename(a)
    a.open("a").write("renamed and grown\n")
    b.write_text("fresh\n")
    assert sorted(tail.batch()) == [("a.jsonl", "renamed and grown"), ("b.jsonl", "fresh")]
    a.unlink()
    assert tail.batch() == []
    a.write_text("back\n")
    assert tail.batch() == [("a.jsonl", "back")]
    assert Tail(f"file://{tmp_path}").batch() == [("a.jsonl", "back"), ("b.jsonl", "fresh")] and Tail(tmp_path / "none").batch() == []


def test_same_head_is_told_apart_by_its_end(tmp_path):
    head = "x" * 3000 + "\n"
    for name, own in (("a", "first\n"), ("b", "second\n")):
        (tmp_path / f"{name}.jsonl").write_text(head + own)
    tail = Tail(tmp_path)
    assert len(tail.batch()) == 4
    (tmp_path / "a.jsonl").rename(tmp_path / "c.jsonl")
    (tmp_path / "b.jsonl").rename(tmp_path / "d.jsonl")
    (tmp_path / "d.jsonl").open("a").write("more\n")
    assert tail.batch() == [("d.jsonl", "more")]
    (tmp_path / "c.jsonl").write_text(head + "other\n")  # rewritten at the same length, with the same head
    assert [x for _, x in tail.batch()] == ["x" * 3000, "other"]


def test_renamed_before_its_batch_was_read(tmp_path):
    (tmp_path / "a.jsonl").write_text("one\ntwo\n")
    reader = TailReader({"path": str(tmp_path)})
    to = reader.latestOffset()
    (tmp_path / "a.jsonl").rename(tmp_path / "b.jsonl")
    spans = TailReader({"path": str(tmp_path)}).partitions(reader.initialOffset(), to)
    assert [r for s in spans for r in reader.read(s)] == [(f"{tmp_path}/a.jsonl", 0, "one"), (f"{tmp_path}/a.jsonl", 4, "two")]
    (tmp_path / "b.jsonl").unlink()
    assert reader.partitions(reader.initialOffset(), to) == []


def test_unchanged_files_are_not_opened_again(tmp_path, monkeypatch):
    (tmp_path / "a.jsonl").write_text("one\n")
    reader, opened = TailReader({"path": str(tmp_path)}), []
    real = TailReader.mark
    monkeypatch.setattr(TailReader, "mark", lambda self, path: opened.append(path) or real(self, path))
    assert reader.latestOffset() == reader.latestOffset() and len(opened) == 1


def test_long_spans_are_split(tmp_path):
    dice = random.Random(1)
    lines = ["é" * dice.randrange(40) + str(i) if dice.random() < 0.9 else "" for i in range(400)]
    text = ("\n".join(lines) + "\nunended").encode()
    (tmp_path / "a.jsonl").write_bytes(text)
    for span in (1, 2, 7, 64, 1000, len(text), 1 << 20):
        tail = Tail(tmp_path, span)
        assert [x for _, x in tail.batch()] == [x for x in lines if x.strip()], span
        assert len(tail.spans) == -(-(len(text) - 7) // span)


def test_stream_over_truncation_and_rename(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()

    def run():
        rows = capture.paired(capture.tail(spark, f"file://{folder}"))
        q = capture.start(rows, lambda b, n: b.write.mode("append").parquet(out), f"file://{tmp_path}/check")
        q.processAllAvailable()
        q.stop()

    file = folder / "s1.jsonl"
    file.write_text(user("one") + "\n" + assistant("a1") + "\n")
    run()
    file.write_text(assistant("a2") + "\n")  # truncated and written anew
    run()
    file.rename(folder / "s2.jsonl")
    with (folder / "s2.jsonl").open("a") as f:
        f.write(assistant("a3") + "\n")
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["s1:a1", "s1:a2", "s2:a3"]
