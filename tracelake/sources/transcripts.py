"""Session transcripts (JSON lines, one file a session) and chat exports as trace rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.messages import human_text_udf, response_body_udf, usage_udf
from tracelake.operators.windows import carry_forward, with_parent
from tracelake.sources.jsonlist import elements

LINE = "struct<type:string,uuid:string,timestamp:string,message:struct<role:string,model:string,content:string,usage:struct<input_tokens:int,output_tokens:int>>>"


def millis(value: Column, otherwise: int) -> Column:
    """ISO-8601 text to epoch milliseconds; what isn't a time is ``otherwise``, the batch's time."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(value)), F.lit(otherwise).cast("bigint"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, line_no, line): complete lines of all .jsonl files below a folder; an unended last line waits."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    named = files.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1).alias("session_id"), F.split("value", "\n").alias("parts"))
    return named.select("session_id", F.posexplode(F.expr("slice(parts, 1, size(parts) - 1)")).alias("line_no", "line")).where(F.trim("line") != "")


def decode(rows: DataFrame) -> DataFrame:
    """Lines with ``kind``: user, assistant, malformed (no JSON) or unknown, and their parsed form ``j``."""
    parsed = rows.withColumn("ok", F.expr("try_parse_json(line) IS NOT NULL")).withColumn("j", F.from_json("line", LINE))
    kind = F.when(~F.col("ok"), "malformed").when(F.col("j.type").isin("user", "assistant"), F.col("j.type")).otherwise("unknown")
    # content is a string or blocks: its raw form is read apart
    return parsed.withColumn("kind", kind).withColumn("content", F.expr("CASE WHEN ok THEN get_json_object(line, '$.message.content') END")).drop("ok")


def stable_id(*parts: Column) -> Column:
    """An id that source, session and key decide: reading a file again gives the same ids and parents."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def traces(decoded: DataFrame, batch_ms: int) -> DataFrame:
    """One row per assistant line: request is the last human text of the session, parent the assistant line before."""
    rows = decoded.where(F.col("kind").isin("user", "assistant")).withColumn("human", F.when(F.col("kind") == "user", human_text_udf("content")))
    paired = carry_forward(rows, "session_id", "line_no", F.col("human").isNotNull(), F.col("human"), "prompt_text").where("kind = 'assistant'")
    out = paired.select(
        stable_id(F.lit("transcript"), F.col("session_id"), F.col("j.uuid")).alias("id"), millis(F.col("j.timestamp"), batch_ms).alias("ts"), F.lit("transcript").alias("source"), F.lit("claude_code").alias("tool"), F.coalesce("j.message.model", F.lit("unknown")).alias("model"),
        F.to_json(F.struct(F.lit("user").alias("role"), F.col("prompt_text").alias("content"))).alias("request_json"), F.get_json_object("line", "$.message").alias("response_json"), F.col("j.message.usage.input_tokens").alias("tokens_in"), F.col("j.message.usage.output_tokens").alias("tokens_out"),
        F.lit(None).cast("int").alias("latency_ms"), F.lit(None).cast("double").alias("cost_usd"), "session_id", F.lit("[]").alias("redaction_flags"), F.lit(False).alias("quarantined"), "prompt_text", F.col("j.uuid").alias("ingest_key"), F.lit("1").alias("parser_version"), "line_no",
    )
    return with_parent(out, "session_id", ["line_no"])


def scan(spark: SparkSession, path: str, batch_ms: int) -> tuple[DataFrame, dict]:
    """Traces below a folder, and counts of files, malformed and unknown lines, and the lag of the newest row in seconds."""
    rows = decode(lines(spark, path))
    found = traces(rows, batch_ms)
    counts = rows.agg(F.count_distinct("session_id").alias("watched"), F.count_if(F.col("kind") == "malformed").alias("parse_errors"), F.count_if(F.col("kind") == "unknown").alias("unknown_lines")).first().asDict()
    newest = found.agg(F.max("ts")).first()[0]
    return found, counts | {"lag_seconds": max(0.0, (batch_ms - newest) / 1000) if newest is not None else None}


_MESSAGE = "struct<uuid:string,sender:string,role:string,text:string,content:string,model:string,created_at:string,timestamp:string>"
_CONVERSATION = f"struct<uuid:string,id:string,chat_messages:array<string>,messages:array<string>>"


def chat_export(spark: SparkSession, path: str, batch_ms: int) -> DataFrame:
    """Assistant messages of chat exports (a list of conversations, or an object that holds one); malformed files give none.

    Every human message replaces the prompt, even one without text. Files are read in ranges, so one may be of any size.
    """
    talks = elements(spark, path, "conversations").withColumn("c", F.from_json("raw", _CONVERSATION))
    session = F.coalesce("c.uuid", "c.id", F.sha2("raw", 256))
    each = talks.select(session.alias("session_id"), F.posexplode(F.coalesce("c.chat_messages", "c.messages")).alias("line_no", "m")).withColumn("j", F.from_json("m", _MESSAGE))
    blocks = human_text_udf(F.get_json_object("m", "$.content"))
    has_text = F.get_json_object("m", "$.text").isNotNull()
    rows = each.withColumn("sender", F.coalesce("j.sender", "j.role")).withColumn("text", F.when(has_text, F.col("j.text")).otherwise(blocks))
    human = F.col("sender").isin("human", "user")
    paired = carry_forward(rows, "session_id", "line_no", human, F.col("text"), "prompt_text").where(F.col("sender").isin("assistant", "bot"))
    key = F.coalesce("j.uuid", F.sha2("m", 256))
    out = paired.select(stable_id(F.lit("claude_export"), F.col("session_id"), key).alias("id"), millis(F.coalesce("j.created_at", "j.timestamp"), batch_ms).alias("ts"), F.lit("claude_export").alias("source"), F.coalesce("j.model", F.lit("unknown")).alias("model"), "session_id", "prompt_text", F.col("text").alias("response_text"), key.alias("ingest_key"), "line_no")
    return with_parent(out, "session_id", ["line_no"])


def captured_bodies(rows: DataFrame, prices: DataFrame, paused: bool = False) -> DataFrame:
    """Proxy landings (status, content_type, request, response, model, latency_ms) as rows with tokens and cost; errors and pauses leave none."""
    kept = rows.where((F.col("status") < 400) & F.lit(not paused)).withColumn("response_json", response_body_udf("content_type", "response")).withColumn("u", usage_udf("response_json"))
    cost = F.col("u.tokens_in") / 1e6 * F.col("pin") + F.col("u.tokens_out") / 1e6 * F.col("pout")
    return kept.join(prices, "model", "left").select(*rows.columns, "response_json", "u.tokens_in", "u.tokens_out", cost.alias("cost_usd"))
