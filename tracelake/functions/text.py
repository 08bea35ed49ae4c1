"""Text and token column expressions: tokens, entropy, secrets, labels, checks of shape."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Secret patterns in the order in which they apply, each replaced by [REDACTED:<name>].
SECRETS = {
    "aws_access_key_id": r"\bAKIA[0-9A-Z]{16}\b",
    "aws_secret_access_key": r"(?i)aws_secret_access_key\s*[:=]\s*['\"]?[A-Za-z0-9/+=]{40}['\"]?",
    "gcp_api_key": r"\bAIza[0-9A-Za-z\-_]{20,40}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b",
    "pem_block": r"-----BEGIN [A-Z ]+-----[\s\S]+?-----END [A-Z ]+-----",
    "slack_token": r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "openai_key": r"\bsk-[A-Za-z0-9]{20,}\b",
    "anthropic_key": r"\bsk-ant-[A-Za-z0-9_-]{20,}\b",
    "generic_kv_secret": r"(?i)\b(api[_-]?key|secret|password|token)\b\s*[:=]\s*['\"]?[A-Za-z0-9_\-/+=]{16,}['\"]?",
}
LONG_TOKEN = r"[A-Za-z0-9+/=_\-]{20,}"
ENTROPY_LIMIT = 3.5
#: Words that say nothing in a label, and the openings of a refusal.
STOP_WORDS = "the a an is are to of in on for and or please can you i me my this that with it be how do does what why we us your our".split()
REFUSAL = r"(?i)^\s*(i'?m sorry|sorry|i can(?:'|no)t|i cannot|i am unable|i'm unable|i won'?t|as an ai)\b"
#: The head of a hunk of a unified diff, and a fenced block of Python.
DIFF_HUNK = r"(?m)^@@ -\d+(,\d+)? \+\d+(,\d+)? @@"
PYTHON_BLOCK = r"(?s)```(?:python|py)\s*\n(.*?)```"
#: What an answer can be checked for - addresses, paths, files, names in code, numbers, inline code; the pattern and its group.
SPECIFICS = (
    (r"https?://[^\s)>\]]+", 0),
    (r"(?:[\w.-]+/)+[\w.-]+", 0),
    (r"\b[\w-]+\.(?:py|js|ts|tsx|go|rs|java|json|ya?ml|toml|md|sql|sh|txt|cfg|ini)\b", 0),
    (r"\b[a-z]+(?:_[a-z0-9]+)+\b", 0),
    (r"\b[a-z]+(?:[A-Z][a-z0-9]+)+\b", 0),
    (r"\b\d+(?:\.\d+)+\b|\b\d{2,}\b", 0),
    (r"`([^`\n]{2,60})`", 1),
)


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text; other letters divide words."""
    return F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9]+"), F.lit(0))


def entropy(token: Column) -> Column:
    """Shannon entropy in bits a character; 0 for the empty string."""
    n = F.length(token)
    part = F.transform(F.array_distinct(F.split(token, "")), lambda c: F.when(c == "", 0.0).otherwise((n - F.length(F.replace(token, c, F.lit("")))) / n))
    return F.aggregate(part, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def _unicode(pattern: str) -> str:
    return "(?U)" + pattern


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def scrubbed(text: Column) -> Column:
    """struct(text, flags): the text after all patterns in order, and the names of those that met; each pattern looks once, at what the ones before left."""
    state = F.struct(text.alias("text"), F.array().cast("array<string>").alias("flags"))
    for name, pattern in SECRETS.items():
        state = _bound(state, _one_pattern(name, pattern))
    return F.when(text.isNotNull(), state)


def _one_pattern(name: str, pattern: str):
    def step(state: Column) -> Column:
        hit = state["text"].rlike(_unicode(pattern))
        clean = F.when(hit, F.regexp_replace(state["text"], _unicode(pattern), f"[REDACTED:{name}]")).otherwise(state["text"])
        return F.struct(clean.alias("text"), F.when(hit, F.array_append(state["flags"], F.lit(name))).otherwise(state["flags"]).alias("flags"))

    return step


def scrub(text: Column) -> Column:
    for name, pattern in SECRETS.items():
        text = F.regexp_replace(text, _unicode(pattern), f"[REDACTED:{name}]")
    return text


def secret_flags(text: Column) -> Column:
    """Names of the patterns that scrubbing meets, in order: each looks at what the ones before left. No text: none."""
    return F.coalesce(scrubbed(text)["flags"], F.array().cast("array<string>"))


def risky_tokens(scrubbed: Column) -> Column:
    """Long tokens of scrubbed text that no pattern knows and whose entropy reaches the limit."""
    every = "|".join(f"(?:{_unicode(p)})" for p in SECRETS.values())
    return F.filter(F.regexp_extract_all(scrubbed, F.lit(LONG_TOKEN), F.lit(0)), lambda t: ~t.rlike(every) & (entropy(t) >= ENTROPY_LIMIT))


def redact(text: Column) -> Column:
    """struct(text, flags, quarantined): scrubbed text; flags end in entropy_quarantine if a risky token is left."""

    def told(state: Column) -> Column:
        return _bound(F.size(risky_tokens(state["text"])) > 0, lambda risky: F.struct(state["text"].alias("text"), F.concat(F.coalesce(state["flags"], F.array().cast("array<string>")), F.when(risky, F.array(F.lit("entropy_quarantine"))).otherwise(F.array().cast("array<string>"))).alias("flags"), risky.alias("quarantined")))

    return _bound(scrubbed(text), told)


def redacted(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the struct of :func:`redact` of a text column as ``name``, in a step of plain columns for each pattern.

    For tables: steps are compiled, which the single expression, with its functions of values, isn't.
    """
    state, kept = f"__{name}", rows.columns
    none = F.array().cast("array<string>")
    steps = rows.withColumns({f"{state}0": F.col(f"`{text}`"), f"{state}f0": none})
    for i, (secret, pattern) in enumerate(SECRETS.items()):
        before, flags = F.col(f"{state}{i}"), F.col(f"{state}f{i}")
        hit = steps.select("*", before.rlike(_unicode(pattern)).alias(f"{state}h"))
        met = F.coalesce(F.col(f"{state}h"), F.lit(False))
        clean = F.when(met, F.regexp_replace(before, _unicode(pattern), f"[REDACTED:{secret}]")).otherwise(before)
        told = F.when(met, F.array_append(flags, F.lit(secret))).otherwise(flags)
        steps = hit.select(*[F.col(f"`{c}`") for c in kept], clean.alias(f"{state}{i + 1}"), told.alias(f"{state}f{i + 1}"))
    last, flags = F.col(f"{state}{len(SECRETS)}"), F.col(f"{state}f{len(SECRETS)}")
    risky = steps.withColumn(f"{state}r", F.size(risky_tokens(last)) > 0)
    all_flags = F.when(F.col(f"{state}r"), F.array_append(flags, F.lit("entropy_quarantine"))).otherwise(flags)
    return risky.select(*[F.col(f"`{c}`") for c in kept], F.struct(last.alias("text"), all_flags.alias("flags"), F.col(f"{state}r").alias("quarantined")).alias(name))


def is_refusal(text: Column) -> Column:
    return F.substring(text, 1, 200).rlike(REFUSAL)


def is_unified_diff(text: Column) -> Column:
    return F.contains(text, F.lit("---")) & F.contains(text, F.lit("+++")) & text.rlike(DIFF_HUNK)


def within_length(text: Column, least: int = 1, most: int = 100_000) -> Column:
    return F.length(text).between(least, most)


def python_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PYTHON_BLOCK), F.lit(1))


def specifics(text: Column) -> Column:
    """Distinct checkable details, stripped, without closing punctuation, of two characters at least."""
    every = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(_unicode(p)), F.lit(group)) for p, group in SPECIFICS]))
    return F.array_distinct(F.filter(F.transform(every, lambda s: F.rtrim(F.trim(s), F.lit(".,;:"))), lambda s: F.length(s) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 when both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def common_subsequence(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, a row of the usual table in one addition.

    A row is held as the places where it doesn't rise, one bit each; with the places of the next element of ``b`` in ``a`` as
    bits, the carries of the addition move each rise to the first such place of its run.
    """
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    flat = every
    for x in b:
        if hit := flat & places.get(x, 0):
            flat = (flat + hit | flat - hit) & every
    return len(a) - flat.bit_count()


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays of strings; nulls in them are equal, and a null array gives null."""

    @F.pandas_udf("int")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else common_subsequence(x, y) for x, y in zip(left, right, strict=True)], dtype="Int32")

    return run(a, b)


def verdict_word(text: Column) -> Column:
    """The last PASS or FAIL word of a judge's answer; null without one."""
    return F.try_element_at(F.regexp_extract_all(F.upper(text), F.lit(r"\b(PASS|FAIL)\b"), F.lit(1)), F.lit(-1))


def stamp_hash(version: Column, rubric: Column, frontier: Column, candidate: Column, passed: Column) -> Column:
    return F.sha2(F.concat_ws("|", version, rubric, frontier, candidate, F.initcap(passed.cast("string"))), 256)


#: Fixed value: Crockford's digits, without I, L, O and U.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid_millis(ulid: Column) -> Column:
    """Milliseconds in the first ten digits of an id."""
    return F.aggregate(F.filter(F.split(F.upper(F.left(ulid, F.lit(10))), ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda acc, c: acc * 32 + F.instr(F.lit(CROCKFORD), c) - 1)


def ulid(millis: Column, source: Column) -> Column:
    """A sortable id of 26 digits: time, then digits that the source decides (stable where others draw at random)."""
    code = F.split(F.lit(CROCKFORD), "")
    digit = lambda n: F.get(code, n.cast("int"))
    time = F.array_join(F.transform(F.sequence(F.lit(9), F.lit(0)), lambda k: digit(F.pmod(F.floor(millis / F.pow(F.lit(32.0), k)), F.lit(32)))), "")
    tail = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: digit(F.pmod(F.conv(F.substr(F.sha2(source, 256), k * 2, F.lit(2)), 16, 10).cast("int"), F.lit(32)))), "")
    return F.concat(time, tail)
