r"""Personal data by weak supervision, from DataFrame functions alone.

Candidates are the matches of fixed patterns, with their code-point places. Base candidates (the four
kinds of the contract) always stay. Wider candidates - single 16-digit numbers inside of longer runs,
telephone numbers without a plus sign, credentials behind a key word - stay if the span classifier says
so. Labelers vote on every candidate: a strict pattern, a validity check (Luhn, digits, entropy by length),
a gazetteer (key words near by, top-level domains) and the context (what stands around the match).
Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability for each
kind without labels, and the posteriors train a logistic classifier over votes and shape. Counts of
patterns are all that reaches the driver; their number is bounded by the number of patterns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stored

#: Kinds in order; the first four have base candidates.
KINDS = ("email", "ip", "card", "phone", "secret")
#: Fixed patterns: a run is entered at its first character or where the last match ended, so no text takes quadratic time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9+/_=-]{12,}[\"']?",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+"}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$",
    "ip": r"^([1-9][0-9]{0,2})(\.[0-9]{1,3}){3}$",
    "card": r"^([0-9]{16}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{17,19})$",
    "phone": r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}$",
    "secret": r"[\"']?[A-Za-z0-9+/_=-]{20,}[\"']?$",
}
#: Gazetteers: words that speak for and against a kind when they stand before a match; top-level domains for email.
FOR = {
    "email": "mail|e-mail|email|contact|write|from|to",
    "ip": "ip|host|server|address|client|addr|from",
    "card": "card|visa|mastercard|amex|credit|debit|payment|no|number",
    "phone": "tel|phone|call|fax|mobile|cell|whatsapp|number",
    "secret": "key|token|secret|password|auth|bearer|login|credential|credentials|config|env|export",
}
#: How the values of well-known credentials begin.
PREFIXES = r"[\"']?(AKIA|ASIA|AIza|eyJ|gh[pousr]_|glpat-|sk-|pk_|rk_|xox[abprs]-|SG\.|npm_)"
AGAINST = "version|release|v|isbn|issn|section|chapter|page|figure|order|invoice|doi|rfc|build"
DOMAINS = r"\.(com|org|net|edu|gov|io|info|biz|co|de|fr|es|it|uk|eu|us|ca|au|nl|ch|at)$"


#: Matches whose places are summed up in one go, see :func:`running`.
RUN = 256


def running(steps: Column) -> Column:
    """Running sums of an array of numbers, in two levels: an append copies its array, so no array of more than RUN sums is appended to."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int"))), lambda b: F.slice(steps, b * RUN + 1, RUN))
    nothing = F.array().cast("array<int>")
    within = lambda block: F.aggregate(block, nothing, lambda acc, x: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    sums = F.transform(blocks, within)
    before = F.aggregate(sums, F.array(F.lit(0)), lambda acc, block: F.array_append(acc, F.element_at(acc, -1) + F.coalesce(F.try_element_at(block, F.lit(-1)), F.lit(0))))
    return F.flatten(F.zip_with(sums, F.slice(before, 1, F.size(sums)), lambda block, low: F.transform(block, lambda x: x + low)))


def spans(rows: DataFrame, text: str, patterns: list[tuple[str, str, str | None]]) -> DataFrame:
    """``rows`` without ``text`` and with a column for each (name, pattern, need): leftmost non-overlapping matches.

    A column is an array of (start, end, m, before, after), places in code points. ``need`` is what a text must hold for
    the pattern to be tried at all. What a match needs is made once a text, in columns of its own, so time is linear in matches.
    """
    rest = [c for c in rows.columns if c != text]
    made = []
    for name, pattern, need in patterns:
        held = F.contains(text, F.lit(need)) if need else F.lit(True)
        made.append(F.when(held, F.split(text, pattern, -1)).otherwise(F.array(F.lit(""))).alias(f"{name}_between"))
        made.append(F.when(held, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"{name}_found"))
    rows = rows.select(*rest, *made)
    names = [n for n, _, _ in patterns]

    def step(name: str) -> Column:
        """How far each match begins from where the one before began."""
        own = F.transform(f"{name}_found", lambda m: F.length(m))
        return F.zip_with(F.slice(F.transform(f"{name}_between", lambda b: F.length(b)), 1, F.size(own)), F.slice(F.concat(F.array(F.lit(0)), own), 1, F.size(own)), lambda a, b: a + b)

    kept = [x for n in names for x in (f"{n}_between", f"{n}_found")]
    rows = rows.select(*rest, *kept, *[step(n).alias(f"{n}_steps") for n in names])
    rows = rows.select(*rest, *kept, *[running(F.col(f"{n}_steps")).alias(f"{n}_starts") for n in names])

    def built(name: str) -> Column:
        between, starts = F.col(f"{name}_between"), F.col(f"{name}_starts")

        def row(m: Column, i: Column) -> Column:
            start = F.get(starts, i)
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("m"), F.lower(F.right(F.get(between, i), F.lit(20))).alias("before"), F.left(F.get(between, i + 1), F.lit(2)).alias("after"))

        return F.transform(f"{name}_found", row)

    return rows.select(*rest, *[built(n).alias(n) for n in names])


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of a match pass the Luhn check."""
    each = F.transform(F.split(F.reverse(digits(m)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, "\\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})$"))
    if kind == "card":
        return F.length(digits(m)).between(16, 19) & luhn(m)
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def sign(yes: Column) -> Column:
    return F.when(yes, 1).otherwise(-1)


def candidate(kind: str, base: bool, c: Column) -> Column:
    near = F.when(c.before.rlike(rf"\b({AGAINST})\b[^a-z0-9]*$"), -1).when(c.before.rlike(rf"\b({FOR[kind]})\b"), 1).otherwise(0)
    listed = sign(F.lower(c.m).rlike(DOMAINS)) if kind == "email" else F.when(c.m.rlike(PREFIXES), 1).otherwise(near) if kind == "secret" else near
    alone = sign(~c.before.rlike("[a-z0-9]$") & ~c.after.rlike("^[A-Za-z0-9]"))
    share = F.length(digits(c.m)) * 4 / F.length(c.m)
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"), c.start.alias("start"), c.end.alias("end"), F.lit(base).alias("base"),
        sign(c.m.rlike(STRICT[kind])).alias("strict"), sign(valid(kind, c.m)).alias("valid"), listed.cast("int").alias("listed"), alone.alias("alone"),
        F.least(F.length(c.m) / 8, F.lit(6)).cast("int").alias("size"), share.cast("int").alias("share"),
    )


VOTES = ("strict", "valid", "listed", "alone")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, wide): arrays of candidates of every text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = [(f"{'base' if base else 'wide'}_{kind}", kind, base) for base, patterns in ((True, BASE), (False, WIDE)) for kind in patterns]
    rows = spans(rows, "text", [(name, (BASE if base else WIDE)[kind], NEEDS.get(kind) if base else None) for name, kind, base in names])
    marked = []
    for name, kind, base in names:
        kept = F.filter(name, _checker(kind)) if base else F.col(name)
        marked.append(F.transform(kept, _marker(kind, base)))
    return rows.select("doc_id", F.concat(*marked[: len(BASE)]).alias("base"), F.concat(*marked[len(BASE) :]).alias("wide"))


def _checker(kind: str):
    return lambda c: valid(kind, c.m)


def _marker(kind: str, base: bool):
    return lambda c: candidate(kind, base, c)


def estimate(rows: list[tuple], rounds: int = 50) -> list[float]:
    """Posterior of each row (kind, votes, ..., n) by EM: a prior for each kind, a reliability for each kind and labeler."""
    kinds = sorted({r[0] for r in rows})
    prior = dict.fromkeys(kinds, 0.7)
    right = {(k, j): 0.8 for k in kinds for j in range(len(VOTES))}
    posterior = [0.5] * len(rows)
    for _ in range(rounds):
        for i, r in enumerate(rows):
            yes, no = math.log(prior[r[0]]), math.log(1 - prior[r[0]])
            for j in range(len(VOTES)):
                vote, p = r[1 + j], right[r[0], j]
                if vote:
                    yes += math.log(p if vote > 0 else 1 - p)
                    no += math.log(1 - p if vote > 0 else p)
            posterior[i] = 1 / (1 + math.exp(min(max(no - yes, -50), 50)))
        for k in kinds:
            own = [(r, p) for r, p in zip(rows, posterior, strict=True) if r[0] == k]
            total = sum(r[-1] for r, _ in own)
            prior[k] = min(max(sum(r[-1] * p for r, p in own) / total, 0.05), 0.95)
            for j in range(len(VOTES)):
                said = sum(r[-1] for r, _ in own if r[1 + j])
                agreed = sum(r[-1] * (p if r[1 + j] > 0 else 1 - p) for r, p in own if r[1 + j])
                # a labeler is taken to be better than chance: without that the two classes may swap
                right[k, j] = min(max((agreed + 4) / (said + 5), 0.55), 0.98)
    return posterior


def shape(kind: int, votes: tuple, size: int, share: int) -> list[float]:
    return [1.0] + [float(kind == k) for k in range(len(KINDS))] + [float(v) for v in votes] + [size / 6, share / 4]


def train(rows: list[tuple], posterior: list[float], rounds: int = 400) -> list[float]:
    """Weights of a logistic classifier of the shapes, by gradient steps over rows weighted by their counts."""
    inputs = [shape(r[0], r[1:5], r[5], r[6]) for r in rows]
    weights = [0.0] * (len(KINDS) + len(VOTES) + 3)
    total = sum(r[-1] for r in rows) or 1
    for _ in range(rounds):
        slope = [0.001 * w for w in weights]
        for x, p, r in zip(inputs, posterior, rows, strict=True):
            z = sum(a * b for a, b in zip(weights, x, strict=True))
            error = (1 / (1 + math.exp(min(max(-z, -50), 50))) - p) * r[-1] / total
            slope = [s + error * v for s, v in zip(slope, x, strict=True)]
        weights = [w - 1.0 * s for w, s in zip(weights, slope, strict=True)]
    return weights


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) per row of docs (doc_id, text): arrays of (kind, start, end), by kind as in KINDS, then start.

    ``base`` are the base spans; ``spans`` these and the wider ones the classifier accepts that overlap no
    base span of their kind. Null or empty texts have none. Rows are independent but for the classifier's
    weights; repeated rows give repeated results; no rows give none; other columns are left aside. A very long text
    is searched as a whole, in time linear in its length and matches. Wider candidates that overlap each other all stay.
    """
    found = stored(candidates(docs), "candidates")
    each = found.select(F.explode(F.concat("base", "wide")).alias("c")).select("c.*")
    keys = ["kind", *VOTES, "size", "share"]
    rows = sorted(tuple(r) for r in each.groupBy(*keys).count().collect())
    weights = train(rows, estimate(rows))

    def accepted(c: Column) -> Column:
        terms = [F.lit(weights[0]), *[F.when(c.kind == k, F.lit(weights[1 + k])).otherwise(0.0) for k in range(len(KINDS))]]
        terms += [c[v] * F.lit(weights[1 + len(KINDS) + j]) for j, v in enumerate(VOTES)]
        terms += [c["size"] / 6 * F.lit(weights[-2]), c["share"] / 4 * F.lit(weights[-1])]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return total >= 0

    # spans as numbers (kind, start, end): those equal to a base span go by a hash set, before overlaps are looked for
    bits = 29
    packed = lambda c: c.kind.cast("bigint") * (1 << 2 * bits) + c.start.cast("bigint") * (1 << bits) + c.end
    opened = lambda x: F.struct(F.shiftright(x, 2 * bits).cast("int").alias("kind"), (F.shiftright(x, bits) % (1 << bits)).cast("int").alias("start"), (x % (1 << bits)).cast("int").alias("end"))
    rows = found.select("doc_id", "base", F.transform("base", packed).alias("own"), F.transform(F.filter("wide", accepted), packed).alias("more"))
    rows = rows.select("doc_id", "base", "own", F.array_except("more", "own").alias("more"))
    rows = rows.select("doc_id", "base", "own", F.transform("more", opened).alias("more"))
    apart = F.filter("more", lambda c: ~F.exists("base", lambda b: (b.kind == c.kind) & (b.start < c.end) & (c.start < b.end)))
    rows = rows.select("doc_id", "own", F.concat("own", F.transform(apart, packed)).alias("every"))
    return rows.select("doc_id", F.transform(F.array_sort("own"), opened).alias("base"), F.transform(F.array_sort("every"), opened).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))), ",")
