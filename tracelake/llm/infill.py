"""Fill-in-the-middle rows: texts are cut at two unit boundaries that a hash draws, and their parts are put in another order.

What a unit is, a grammar says: alternatives of a character class in brackets, with ``+`` for runs of it, such as
``[A-Za-z]+|[^A-Za-z]``. The classes don't overlap; a character of none of them is a unit of its own. Such a grammar has a
boundary exactly where two neighbours aren't in the same run, so it is turned into a pattern of zero width that looks only
at the neighbours, and Spark's ``split`` at it keeps every character.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import for_texts, fresh

#: Grammars: words of ASCII letters and single other characters; these, numbers and blanks as runs; single characters.
WORDS = "[A-Za-z]+|[^A-Za-z]"
RUNS = r"[A-Za-z]+|[0-9]+|[ \t]+|[^A-Za-z0-9 \t]"
CHARACTERS = r"[\s\S]"

_CLASS = r"\[(?:\\.|[^\]\\])+\]"
MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"


def boundary(grammar: str) -> str:
    """The pattern of zero width that matches between units of ``grammar``, and not at either end of a text.

    ``(?<=[\\s\\S])`` holds off places between the halves of a character that takes two UTF-16 units: nothing ends there.
    """
    if not re.fullmatch(rf"{_CLASS}\+?(?:\|{_CLASS}\+?)*", grammar):
        raise ValueError("a grammar is classes in brackets, each with or without +, divided by |")
    runs = [c[:-1] for c in re.findall(rf"{_CLASS}\+?", grammar) if c.endswith("+")]
    between = [f"(?<={c})(?!{c})" for c in runs] + ["".join(f"(?<!{c})" for c in runs)]
    return rf"(?:{'|'.join(between)})(?<=[\s\S])(?!\z)"


def units(text: Column, grammar: str = WORDS) -> Column:
    """The units of a text as an array, whose join is the text; none of an empty text, which a split would give one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def draws(seed: str, key: Column) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of the seed, a colon and the key; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. A marker can't arise in or across parts, since no part holds one and markers begin and end in characters of their own."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == PLAIN, output).when(form == PSM, F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def fill_in_middle(docs: DataFrame, *, text: str = "text", key: str = "doc_id", grammar: str = WORDS, seed: str = "1", plain: int = 10, spm: int = 20) -> DataFrame:
    """``docs`` with n (units), form, prefix_chars, middle_chars and output, one row a row and without a shuffle.

    The prefix ends at the smaller of two drawn numbers of units, the middle at the larger, the suffix is the rest.
    ``form`` is plain for an empty text (a null one too), one that holds a marker, and ``plain`` of a hundred draws; of the rest
    ``spm`` of a hundred go suffix first, the others prefix first. Lengths are code points and null where plain.

    Draws hang on ``key`` alone, so repeated rows give repeated results and a null key draws as an empty one. Texts are taken
    whole. Other columns stay; those with a made name, in any case, are replaced. An empty table gives none.
    """
    for_texts(docs.sparkSession)
    made = ("n", "form", "prefix_chars", "middle_chars", "output")
    rest = [c for c in docs.columns if c.lower() not in made]
    own = {k: fresh(docs, f"__{k}") for k in ("text", "units", "h", "low", "high", "prefix", "middle", "suffix")}
    col = {k: F.col(v) for k, v in own.items()}
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in rest]
    # each step is computed once: the optimizer joins no selects whose columns are dear and used twice
    cut = docs.select(*kept, whole.alias(own["text"]), F.array(*draws(seed, F.col(f"`{key}`"))).alias(own["h"])).select(*kept, col["text"], col["h"], units(col["text"], grammar).alias(own["units"]))
    n = F.size(col["units"]).cast("bigint")
    is_plain = (col["text"] == "") | F.contains(col["text"], F.lit(MARKS[0])) | F.contains(col["text"], F.lit(MARKS[1])) | F.contains(col["text"], F.lit(MARKS[2])) | (col["h"][2] % 100 >= 100 - plain)
    form = F.when(is_plain, PLAIN).when(col["h"][3] % 100 < spm, SPM).otherwise(PSM)
    ends = [col["h"][i] % (n + 1) for i in (0, 1)]
    placed = cut.select(*kept, col["text"], col["units"], n.alias("n"), form.alias("form"), F.least(*ends).cast("int").alias(own["low"]), F.greatest(*ends).cast("int").alias(own["high"]))
    moved = F.col("form") != PLAIN
    part = lambda start, length: F.when(moved, F.array_join(F.slice(col["units"], start, length), ""))
    parts = placed.select(*kept, col["text"], "n", "form", part(F.lit(1), col["low"]).alias(own["prefix"]), part(col["low"] + 1, col["high"] - col["low"]).alias(own["middle"]), part(col["high"] + 1, F.size(col["units"]) - col["high"]).alias(own["suffix"]))
    p, s, m = (F.lit(x) for x in MARKS)
    output = F.when(~moved, col["text"]).when(F.col("form") == PSM, F.concat(p, col["prefix"], s, col["suffix"], m, col["middle"])).otherwise(F.concat(s, col["suffix"], p, col["prefix"], m, col["middle"]))
    length = lambda c: F.length(c).cast("bigint")
    return parts.select(*kept, "n", "form", length(col["prefix"]).alias("prefix_chars"), length(col["middle"]).alias("middle_chars"), output.alias("output"))
