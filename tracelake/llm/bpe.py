"""Byte-level BPE as a lazily determinised finite-state transducer.

A token sequence is the BPE encoding of its bytes exactly when every neighbouring pair of it is the
encoding of that pair's bytes, so the encoding of a text is the one path through the vocabulary whose
neighbours are all compatible. The non-deterministic transducer has a hypothesis for each place where
the next token may have begun: its node in the vocabulary's trie, the last token before it, and the
tokens not yet written. A deterministic state is the ordered set of live hypotheses; states and arcs
are made when first met. What all hypotheses have in common is written at once; no hypothesis can stay
open beyond the longest token, which bounds the lookahead.

Decoding streams: bytes of tokens pass an incremental UTF-8 automaton that holds back an unfinished
character until its last byte has come.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import kept, tidy

#: The letters and numbers that Unicode has gained since version 16.0, by which the compared tokenizer splits.
LATER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 "
    "1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F "
    "2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def char_class(ranges: str) -> str:
    """The inside of a character class for ranges of hexadecimal code points."""
    return "".join("-".join(f"\\U{int(end, 16):08x}" for end in r.split("-")) for r in ranges.split())


#: White space below U+0250, as inside of a character class.
WHITE = r"\t-\r\x20\x85\xa0"


#: Bounds of the memo tables of one worker: what is met when they are full is computed and not kept. After STALE
#: misses they start afresh, for input that has changed. They change no result.
MAX_WORDS, MAX_ARCS, STALE = 120_000, 140_000, 6_000_000
INFINITE = float("inf")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def merge(ranks: dict[bytes, int], data: bytes) -> list[int]:
    """The definition: join the neighbours of lowest joint rank, leftmost first, until none has one."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Encodes one piece of text (a match of the splitting pattern) at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                if byte not in self.child[node]:
                    self.child[node][byte] = len(self.child)
                    self.child.append({})
                    self.ends.append(None)
                node = self.child[node][byte]
            self.ends[node] = rank
        self.fits: dict[tuple[int, int], bool] = {}
        self.made: dict[int, tuple[float, list, list]] = {}
        self.reset()

    def reset(self) -> None:
        #: A state's hypotheses: (trie node, last token or -1 at the start, tokens not yet written).
        self.states: list[tuple] = [((0, -1, ()),)]
        self.number = {self.states[0]: 0}
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}
        #: The state in use where it isn't kept; its number is -1.
        self.loose: tuple = ()
        self.misses = 0

    def making(self, token: int) -> tuple[float, list, list]:
        """When a token is complete, if ranks are times, and the tokens at its left and right edge until then.

        An edge is a list of (bytes, begin, end), the widest first. A token that merging never makes has time infinity.
        """
        known = self.made.get(token)
        if known is None:
            data = self.token[token]
            known = (-1.0, [(data, -1.0, INFINITE)], [(data, -1.0, INFINITE)])
            if len(data) > 1:
                # the last step of the merging joins the two parts that are left
                parts = merge({t: r for t, r in self.ranks_within(data).items() if t != data}, data)
                if len(parts) == 2 and merge(self.ranks_within(data), data) == [token]:
                    left, right = self.making(parts[0]), self.making(parts[1])
                    time = max(float(token), left[0], right[0])
                    whole = [(data, time, INFINITE)]
                    known = (time, whole + [(x, begin, min(end, time)) for x, begin, end in left[1]], whole + [(x, begin, min(end, time)) for x, begin, end in right[2]])
                else:
                    known = (INFINITE, [], [])
            self.made[token] = known
        return known

    def ranks_within(self, data: bytes) -> dict[bytes, int]:
        found = ((data[i:j], self.ranks.get(data[i:j])) for i in range(len(data)) for j in range(i + 1, len(data) + 1))
        return {t: r for t, r in found if r is not None}

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: may begin a piece): no edge tokens that meet would join across the seam first."""
        known = self.fits.get((left, right))
        if known is None:
            after = self.making(right)
            known = after[0] < INFINITE
            if known and left >= 0:
                before, ranks = self.making(left), self.ranks
                known = before[0] < INFINITE
                for x, x_begin, x_end in before[2]:
                    for y, y_begin, y_end in after[1]:
                        begin = max(x_begin, y_begin)
                        if begin < x_end and begin < y_end and (joint := ranks.get(x + y)) is not None:
                            # of equal ranks the leftmost joins first: x's own, then the seam, then y's own
                            time = max(joint, begin)
                            if time < x_end and time <= y_end:
                                known = False
            if len(self.fits) < MAX_ARCS:
                self.fits[left, right] = known
        return known

    def arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the arc of ``byte`` out of ``state``: the next state and the tokens written on the way."""
        alive, begun = [], None
        self.misses += 1
        for node, last, pending in self.states[state] if state >= 0 else self.loose:
            to = self.child[node].get(byte)
            if to is None:
                continue
            if self.child[to]:
                alive.append((to, last, pending))
            token = self.ends[to]
            if begun is None and token is not None and self.compatible(last, token):
                begun = (0, token, (*pending, token))
        alive.append(begun)
        first, same = alive[0][2], 0
        while all(len(h[2]) > same and h[2][same] == first[same] for h in alive) and len(first) > same:
            same += 1
        to = tuple((node, last, pending[same:]) for node, last, pending in alive)
        number = self.number.get(to, -1)
        keep = state >= 0 and len(self.arcs) < MAX_ARCS
        if number < 0:
            if keep:
                number = self.number[to] = len(self.states)
                self.states.append(to)
            else:
                self.loose = to
        made = (number, first[:same])
        if keep:
            self.arcs[state << 8 | byte] = made
        return made

    def encode(self, piece: bytes) -> list[int]:
        if self.misses > STALE:
            self.reset()
        state, out, arcs = 0, [], self.arcs
        for byte in piece:
            step = (arcs.get(state << 8 | byte) if state >= 0 else None) or self.arc(state, byte)
            state = step[0]
            if step[1]:
                out.extend(step[1])
        out.extend((self.states[state] if state >= 0 else self.loose)[-1][2])
        return out


class Utf8Stream:
    """Incremental UTF-8: ``feed`` gives the characters that are complete, ``close`` the rest.

    State between calls: the bytes of an unfinished character. Bytes that can't be UTF-8 become U+FFFD.
    """

    #: By a lead byte: how many bytes its character has, and the range of the second.
    LEADS = ((0xC2, 0xDF, 2, 0x80, 0xBF), (0xE0, 0xE0, 3, 0xA0, 0xBF), (0xE1, 0xEC, 3, 0x80, 0xBF), (0xED, 0xED, 3, 0x80, 0x9F), (0xEE, 0xEF, 3, 0x80, 0xBF), (0xF0, 0xF0, 4, 0x90, 0xBF), (0xF1, 0xF3, 4, 0x80, 0xBF), (0xF4, 0xF4, 4, 0x80, 0x8F))

    def __init__(self):
        self.held = b""

    @classmethod
    def unfinished(cls, data: bytes) -> int:
        """How many bytes at the end begin a character that more bytes could complete."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if 0x80 <= lead <= 0xBF:
                continue
            for low, high, size, second, last in cls.LEADS:
                if low <= lead <= high:
                    return back if back < size and (back == 1 or second <= data[1 - back] <= last) else 0
            return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self.unfinished(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", "replace")


class Codec:
    """Splits, encodes and decodes whole texts, with memo tables of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.usual = regex.compile(pattern).findall
        # below U+0250 the classes are short enough for the standard library's faster matcher
        letters, numbers = ("".join(rf"\U{c:08x}" for c in range(0x250) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
        plain = {r"\p{L}": letters, r"\p{N}": numbers}
        latin = re.sub(r"\[\^\\s\\p\{L\}\\p\{N\}\]", lambda m: rf"[^{WHITE}{letters}{numbers}]", pattern)
        latin = re.sub(r"\\p\{[LN]\}", lambda m: f"[{plain[m[0]]}]", latin).replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
        self.latin = re.compile(latin).findall
        self.beyond = re.compile("[^\\x00-\\u024f]").search
        self.later = re.compile(f"[{char_class(LATER_LETTERS + ' ' + LATER_NUMBERS)}]").search
        inner = {r"\p{L}": rf"[\p{{L}}--[{char_class(LATER_LETTERS)}]]", r"\p{N}": rf"[\p{{N}}--[{char_class(LATER_NUMBERS)}]]"}
        self.strict = regex.compile("(?V1)" + re.sub(r"\\p\{[LN]\}", lambda m: inner[m[0]], pattern)).findall
        self.bytes_of: list[bytes] = [b""] * (1 + max(ranks.values()))
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        codec = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                ids = codec.transducer.encode(word.encode())
                packed = struct.pack(f"<{len(ids)}I", *ids)
                codec.misses += 1
                if len(word) < 64 and len(self) < MAX_WORDS:
                    self[word] = packed
                return packed

        self.words = Words()
        self.misses = 0

    def split(self, text: str) -> list[str]:
        """Matches of the pattern under Unicode 16.0; only texts with later characters need the longer form."""
        if text.isascii() or not self.beyond(text):
            return self.latin(text)
        return self.strict(text) if self.later(text) else self.usual(text)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self.misses > STALE:
            self.words.clear()
            self.misses = 0
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def decode(self, ids: bytes, step: int = 1 << 16) -> Iterator[str]:
        """Text piece by piece, from ``step`` tokens at a time."""
        stream, look = Utf8Stream(), self.bytes_of.__getitem__
        for at in range(0, len(ids), 4 * step):
            chunk = ids[at : at + 4 * step]
            yield stream.feed(b"".join(map(look, struct.unpack(f"<{len(chunk) // 4}I", chunk))))
        yield stream.close()


def codec(key: tuple, ranks: bytes, pattern: str) -> Codec:
    """This worker's codec for a vocabulary; tasks after the first use it again."""
    return kept(key, lambda: Codec({base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x.strip())}, pattern))


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", keep: Iterable[str] = ("doc_id",), digests: bool = True) -> DataFrame:
    """Encode and decode the whole of column ``text`` of every row.

    Returns the columns ``keep`` and ``n_tokens``; with ``digests`` ``ids_sha256`` and ``decoded_sha256``,
    else ``token_ids`` (array of int) and ``decoded`` (string). Null text is an empty text: no tokens.
    Rows are independent: repeated rows give repeated results, an empty table none, other columns are
    left aside. The vocabulary file (a fixed public file of under 2 MB) is read on the driver and sent out.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as file:
        data = file.read()
    key = (hashlib.sha256(data).hexdigest(), pattern)
    sent = spark.sparkContext.broadcast(data)
    keep = list(keep)
    kinds = dict(zip(docs.columns, docs.schema.fields, strict=True))
    source = docs.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    made = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")] if digests else [("n_tokens", "bigint"), ("token_ids", "array<int>"), ("decoded", "string")]
    out_schema = ", ".join([f"k{i} {kinds[k].dataType.simpleString()}" for i, k in enumerate(keep)] + [f"{n} {t}" for n, t in made])

    def run(batches):
        own = codec(key, sent.value, pattern)
        for batch in batches:
            counts, first, second = [], [], []
            for value in batch.column(len(keep)):
                ids = own.encode(value.as_py())
                counts.append(len(ids) // 4)
                if digests:
                    decoded = hashlib.sha256()
                    for piece in own.decode(ids):
                        decoded.update(piece.encode())
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(decoded.hexdigest())
                else:
                    first.append(list(struct.unpack(f"<{len(ids) // 4}i", ids)))
                    second.append("".join(own.decode(ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(first, pa.string() if digests else pa.list_(pa.int32())), pa.array(second, pa.string())], names=[*batch.schema.names[: len(keep)], *[n for n, _ in made]])

    return source.mapInArrow(tidy(run, key), out_schema).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], *[n for n, _ in made])
