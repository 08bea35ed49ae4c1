r"""Chat formatting with a grammar round trip, from DataFrame functions alone.

Grammar of a rendered conversation: turns, each ``<turn ROLE>`` + line feed + body + line feed +
``</turn>`` + line feed. ROLE is URL-encoded. A control string in a body (``<turn `` or ``</turn>`` or
``### ``, and the same behind backslashes) is escaped by one more backslash in front, so no body holds
the bare end mark and a parser needs no lookahead: it splits at the end marks, reads the header line
and takes one backslash from each escaped control string.

Each conversation is first rendered as it is, reparsed and compared to its source. Where the turns that
come back differ, the conflicting texts are escaped and it is rendered anew; the escaped form is parsed
and compared again, and ``exact`` tells the outcome, which by the grammar is always true.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "\n</turn>\n"
CONTROL = r"(\\*(?:</?turn[ >]|### ))"
ESCAPED = r"\\(\\*(?:</?turn[ >]|### ))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1")


def header(role: Column) -> Column:
    return F.concat(F.lit("<turn "), F.url_encode(role), F.lit(">\n"))


def render(turns: Column, body) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t.role), body(t.text), F.lit(END))), "")


def parse(formatted: Column) -> Column:
    """Turns (role, text) read back from a rendered conversation."""
    pieces = F.split(formatted, END, -1)
    whole = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        role = F.url_decode(F.regexp_extract(head, "^<turn ([^>]*)>$", 1))
        # a body that holds the end mark in the plain rendering leaves a piece without a line feed
        return F.struct(role.alias("role"), unescape(F.substr(piece, F.length(head) + 2)).alias("text"))

    return F.transform(whole, turn)


def format_conversations(rows: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conv_id from rows (conv_id, turn, role, text).

    Columns: conv_id, formatted (the text), turns (array of role and text, read back), mask (for each
    turn the code points before its loss text and those of the loss text, 0 for turns not of role
    ``trained``), escaped (whether the second rendering was needed), exact (recovered equals source).
    Turns are in order of (turn, role, text), nulls first, so ties are settled and repeated rows stay.
    Null text and null role are empty. A row with a null conv_id is a conversation of its own. A
    conversation's turns meet in one row, as its text does. No rows give no rows; other columns are left aside.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("all"))
    alone = rows.where("conv_id IS NULL").select("conv_id", F.array(turn).alias("all"))
    source = known.unionByName(alone).select("conv_id", F.transform("all", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("source"))
    plain = source.withColumn("plain", render(F.col("source"), lambda text: text))
    conflict = plain.withColumn("escaped", ~F.equal_null(parse(F.col("plain")), F.col("source")))
    formatted = conflict.withColumn("formatted", F.when(F.col("escaped"), render(F.col("source"), escape)).otherwise(F.col("plain"))).drop("plain")
    back = formatted.withColumn("turns", parse(F.col("formatted")))

    def run(turn: Column) -> Column:
        body = F.length(F.when(F.col("escaped"), escape(turn.text)).otherwise(turn.text))
        before = F.length(header(turn.role))
        learned = turn.role == trained
        return F.struct(F.when(learned, before).otherwise(before + body + len(END)).alias("skip"), F.when(learned, body).otherwise(0).alias("take"), F.when(learned, len(END)).otherwise(0).alias("after"))

    return back.select("conv_id", "formatted", "turns", F.transform("turns", run).alias("mask"), "escaped", F.equal_null(F.col("turns"), F.col("source")).alias("exact"))


def loss_text(formatted: Column, mask: Column, escaped: Column) -> Column:
    """What the mask cuts out of the rendered text, turn by turn, unescaped and joined."""
    at = F.aggregate(mask, F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,take:int>>").alias("cuts")), _next_cut, lambda acc: acc.cuts)
    pieces = F.transform(at, lambda c: F.substr(formatted, c.at, c["take"]))
    return F.array_join(F.transform(F.filter(pieces, lambda p: p != ""), lambda p: F.when(escaped, unescape(p)).otherwise(p)), "")


def _next_cut(acc: Column, m: Column) -> Column:
    begin = acc.at + m.skip
    cuts = F.when(m["take"] > 0, F.array_append(acc.cuts, F.struct(begin.alias("at"), m["take"].alias("take")))).otherwise(acc.cuts)
    return F.struct((begin + m["take"] + m.after).alias("at"), cuts.alias("cuts"))


def digests(done: DataFrame) -> DataFrame:
    """The digest columns of formatted conversations, from what was read back; the loss text is cut out of ``formatted`` by the mask."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    done = done.select("conv_id", "formatted", "turns", "exact", loss_text(F.col("formatted"), F.col("mask"), F.col("escaped")).alias("loss"))
    return done.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "exact",
    )
