"""Lists of JSON cut in ranges of any size: the same elements as a parser's, whatever stands in their strings."""

import gzip
import json
import random

import pytest

from tracelake.sources import jsonlist

DICE = random.Random(2)
NASTY = ['"', "\\", '\\"', "[", "]", "{", "}", '"conversations": [', "é", "\U0001f600", "\n", ",", "x", ""]


def value(depth=0):
    kind = DICE.randrange(5 if depth < 3 else 2)
    if kind < 2:
        return "".join(DICE.choices(NASTY, k=DICE.randrange(12)))
    if kind == 2:
        return DICE.choice([None, True, 1.5, -3])
    return [value(depth + 1) for _ in range(DICE.randrange(4))] if kind == 3 else {f"k{i}" + DICE.choice(NASTY): value(depth + 1) for i in range(DICE.randrange(4))}


@pytest.mark.parametrize("size", [7, 61, 1 << 20])
def test_same_elements(spark, tmp_path, size):
    talks = [[{"n": i, "v": value()} for i in range(DICE.randrange(8))] for _ in range(4)]
    texts = {
        "list": json.dumps(talks[0], indent=1), "raw": "﻿ \n" + json.dumps(talks[1], ensure_ascii=False), "mixed": json.dumps([1, "a[", {"n": 0}, None, [2]]), "empty": "", "none": "[]",
        "held": json.dumps({"a": [{"x": 1}], "b\\": '"conversations": [', 'x"conversations': [[3]], "conversations": talks[2], "z": [[{"y": 2}]]}, indent=2), "other": json.dumps({"a": talks[3]}), "cut": json.dumps(talks[0])[:-1], "bad": '[{"a": 1}, {"b": nope}]', "text": "hello",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text, "utf-8")
    (tmp_path / "packed.json.gz").write_bytes(gzip.compress(json.dumps(talks[3]).encode()))
    got = {}
    for r in jsonlist.elements(spark, f"file://{tmp_path}", "conversations", size).orderBy("path", "at").collect():
        got.setdefault(r.path.rpartition("/")[2].split(".")[0], []).append(json.loads(r.raw))
    want = {"list": talks[0], "raw": talks[1], "held": talks[2], "packed": talks[3], "mixed": [{"n": 0}, [2]]}
    assert got == {k: v for k, v in want.items() if v}


def test_many_tasks_read_one_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"n": i, "v": "x" * 900} for i in range(2000)]))
    rows = jsonlist.elements(spark, f"file://{tmp_path}", "conversations", 1 << 17)
    assert rows.count() == 2000 and sorted(json.loads(r.raw)["n"] for r in rows.collect()) == list(range(2000))
