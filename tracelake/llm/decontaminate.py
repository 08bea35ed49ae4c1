"""Benchmark decontamination by the q-gram lemma and banded alignment.

A passage within k edits of a benchmark item of m code points shares at least m - q + 1 - k*q character
q-grams with it, all on diagonals (place in the document less place in the item) that differ by at most
k. Shared q-grams are counted in overlapping diagonal bands; a band with enough of them is a region, and
a banded alignment of the item within the region counts its edits. Nothing within the budget is missed.

Items are searched for as a whole and by parts, each with a budget of its own: their lines, and windows
of WINDOW code points that overlap by half. So any WINDOW * 3 / 2 code points of an item in a row hold a
whole window. Items too short for that (fewer than SHORTEST) are searched for as they stand, as whole words.

The index of the benchmark goes to the executors in blocks of a bounded size, one pass over the
documents a block, so a larger benchmark makes more passes and no larger broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import annotate, fresh, kept as worker_kept

Q = 12
#: Edits allowed for each code point of an item or part; items of fewer code points than SHORTEST allow none, and are no parts.
RATE, SHORTEST = 0.05, 24
#: Code points of a window of an item.
WINDOW = 48
_WORDS = re.compile(r"\w+|[^\w\s]")
#: Code points of benchmark items in one pass over the documents.
BLOCK = 1_000_000
#: Pairs of places that share a q-gram looked at in one go.
PAIRS = 4_000_000
_SPREAD = 20


def _fold_table() -> np.ndarray:
    """Lower case where that is one character, and a space for each white space, by code point."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        low = chr(c).lower() if not 0xD800 <= c < 0xE000 else ""
        if chr(c).isspace():
            table[c] = 32
        elif len(low) == 1:
            table[c] = ord(low)
    return table


_FOLD: list[np.ndarray] = []


def folded(text: str) -> np.ndarray:
    if not _FOLD:
        _FOLD.append(_fold_table())
    return _FOLD[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def qgram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the q-gram (12 characters) that begins at each place: of 1, 2, 4 and 8 characters, then 8 and 4."""
    h, width, factors = codes.astype(np.uint32), 1, [np.uint32(0x9E3779B1)]
    while width < 8:
        four, h = h, h[:-width] * factors[-1] + h[width:]
        factors.append(np.uint32(int(factors[-1]) ** 2 & 0xFFFFFFFF))
        width *= 2
    four = four[8:] if len(four) > 8 else four[:0]
    return (h[: len(four)] * factors[2] + four) * np.uint32(0x85EBCA6B)


def budget(m: int) -> int:
    """Edits for an item of m code points; never so many that the lemma would ask for no q-gram."""
    return max(0, min(int(m * RATE), (m - Q) // Q - 1))


def as_text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def parts(text: str) -> list[tuple[int, int]]:
    """(start, end) of the lines and windows of an item, but for the whole."""
    found, at = set(), 0
    for line in text.split("\n"):
        start = at + len(line) - len(line.lstrip())
        end = at + len(line.rstrip())
        if end - start >= SHORTEST:
            found.add((start, end))
        at += len(line) + 1
    if len(text) > WINDOW:
        found |= {(i, i + WINDOW) for i in (*range(0, len(text) - WINDOW, WINDOW // 2), len(text) - WINDOW)}
    return sorted(found - {(0, len(text))})


class Index:
    """Items of one block, their parts, and where the q-grams of both stand. Entries are items and parts of ``owner``."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.texts = [folded(text) for _, text in items]
        self.short: dict[str, list[tuple[int, str]]] = {}
        entries = []
        for k, (_, text) in enumerate(items):
            if len(text) >= SHORTEST:
                entries += [(k, 0, len(text), True), *((k, a, b, False) for a, b in parts(text))]
            elif word := _WORDS.match(low := as_text(self.texts[k])):
                self.short.setdefault(word[0], []).append((k, low))
        self.owner, self.offset, self.whole = [e[0] for e in entries], [e[1] for e in entries], [e[3] for e in entries]
        self.codes = [self.texts[k][a:b] for k, a, b, _ in entries]
        self.edits = np.array([budget(len(c)) for c in self.codes], np.int64)
        self.needed = np.array([len(c) - Q + 1 - k * Q for c, k in zip(self.codes, self.edits.tolist(), strict=True)], np.int64)
        #: Diagonals of half a band of each entry, by its own edits: places of an entry in one band or in neighbouring ones overlap.
        self.band = self.edits + 1
        self.shift = max(map(len, self.codes), default=0)
        hashes = np.concatenate([qgram_hashes(c) for c in self.codes] or [np.zeros(0, np.uint32)])
        item = np.repeat(np.arange(len(entries)), np.array([len(c) - Q + 1 for c in self.codes], np.int64))
        place = np.concatenate([np.arange(len(c) - Q + 1) for c in self.codes] or [np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        self.keys, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(hashes))
        self.item, self.place = item[order], place[order]
        self.seen = np.zeros(1 << _SPREAD, bool)
        self.seen[self.keys >> np.uint32(32 - _SPREAD)] = True
        self.least = int(self.needed.min(initial=1 << 30))

    def diagonals(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(keys, counts, width): shared q-grams of each entry and diagonal, a key being entry * width + diagonal, in order.

        Diagonals are shifted by the longest entry to be positive. So many pairs of places are looked at in one go, at most.
        """
        width = len(hashes) + self.shift + 1
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), width
        at = np.flatnonzero(self.seen[hashes >> np.uint32(32 - _SPREAD)])
        if len(at) < self.least:
            return none
        key = np.searchsorted(self.keys, hashes[at])
        key[key == len(self.keys)] = 0
        true = self.keys[key] == hashes[at]
        at, key = at[true], key[true]
        if len(at) < self.least:
            return none
        many = self.first[key + 1] - self.first[key]
        keys, counts = none[:2]
        ends, begin = many.cumsum(), 0
        while begin < len(at):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
            some = many[begin:stop]
            entry = np.repeat(self.first[key[begin:stop]] - np.concatenate([[0], some.cumsum()[:-1]]), some) + np.arange(some.sum())
            met = self.item[entry] * width + np.repeat(at[begin:stop], some) - self.place[entry] + self.shift
            own, times = np.unique(met, return_counts=True)
            if len(keys):
                own, back = np.unique(np.concatenate([keys, own]), return_inverse=True)
                times = np.bincount(back, np.concatenate([counts, times])).astype(np.int64)
            keys, counts, begin = own, times, stop
        return keys, counts, width

    def regions(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(entry, first diagonal, fullest diagonal) of the bands with enough shared q-grams, the fullest first.

        A band of an entry spans twice ``band`` diagonals.
        """
        keys, counts, width = self.diagonals(hashes)
        if not len(keys):
            return
        entry, diagonal = keys // width, keys % width
        low = diagonal // self.band[entry]
        # a band starts at each multiple of the entry's, so each diagonal is in two of them
        bands, back = np.unique(np.concatenate([entry * width + low, (entry * width + low - 1)[low > 0]]), return_inverse=True)
        total = np.bincount(back, np.concatenate([counts, counts[low > 0]]))
        enough = np.flatnonzero(total >= self.needed[bands // width])
        for band in bands[enough[np.argsort(-total[enough], kind="stable")]].tolist():
            e = band // width
            step = int(self.band[e])
            first = band % width * step
            a, b = np.searchsorted(keys, [e * width + first, e * width + min(first + 2 * step, width)])
            yield e, first - self.shift, int(diagonal[a + counts[a:b].argmax()]) - self.shift


def banded_edits(item: np.ndarray, text: np.ndarray, low: int, width: int, limit: int) -> tuple[int, int, int] | None:
    """Best alignment of the whole item with a part of ``text`` on diagonals low .. low + width: (edits, start, end).

    None where it has more than ``limit`` edits.
    """
    lanes = width + 1
    place = low + np.arange(lanes)
    far = np.int64(1 << 30)
    cost = np.where((place >= 0) & (place <= len(text)), 0, far)
    start = place.copy()
    lane = np.arange(lanes)
    for i in range(len(item)):
        # lane d of row i + 1 ends before text[low + d + i + 1]
        end = place + i + 1
        inside = (end >= 1) & (end <= len(text))
        same = np.zeros(lanes, np.int64)
        same[inside] = text[end[inside] - 1] != item[i]
        diagonal = np.where(inside, cost + same, far)
        above = np.append(cost[1:] + 1, far)
        above_start = np.append(start[1:], 0)
        take = above < diagonal
        cost, start = np.where(take, above, diagonal), np.where(take, above_start, start)
        # insertions run along the row
        run = cost - lane
        best = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == best, lane, 0))
        cost, start = best + lane, start[source]
        cost = np.where((end >= 0) & (end <= len(text)), cost, far)
        if cost.min() > limit:
            return None
    d = int(cost.argmin())
    return int(cost[d]), int(start[d]), int(place[d] + len(item))


def _part_ranges(found: list[tuple], codes: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """Parts (item, place, start, end, size, band) that follow each other in item and text, joined: (item, start, end, edits)."""
    joined: list[list[int]] = []
    for item, place, start, end, size, band in sorted(found):
        for run in joined:
            # within one passage the diagonals differ by edits only; lines are parted by a line feed
            if run[0] == item and abs((start - place) - (run[3] - run[1])) <= 2 * max(band, run[7]) and place <= run[2] + 2 and start <= run[4] + 2:
                run[2], run[4] = max(run[2], place + size), max(run[4], end)
                run[5], run[6], run[7] = min(run[5], start - place), max(run[6], start - place), max(run[7], band)
                break
        else:
            joined.append([item, place, place + size, start, end, start - place, start - place, band])
    out = []
    for item, first, last, start, end, low, high, band in joined:
        own = index.texts[item][first:last]
        if end - start == len(own) and np.array_equal(codes[start:end], own):
            out.append((item, start, end, 0))
            continue
        best = banded_edits(own, codes, low + first - 2 * band, high - low + 4 * band, 1 << 29)
        out.append((item, best[1], best[2], best[0]) if best is not None else (item, start, end, 0))
    return out


def short_items(codes: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(item, start, end, 0) of the items too short for q-grams, where no letter or digit adjoins."""
    if not index.short:
        return []
    low, out = as_text(codes), []
    for word in _WORDS.finditer(low):
        for item, own in index.short.get(word[0], []):
            end = word.start() + len(own)
            if low.startswith(own, word.start()) and not (re.match(r"\w", own[-1]) and re.match(r"\w", low[end : end + 1])):
                out.append((item, word.start(), end, 0))
    return out


def passages(text: str, index: Index) -> list[tuple[int, int, int, int]]:
    """(item_id, start, end, edits) for each place of an item in a text, and of a part of it where the whole is not.

    Of places of one item that overlap, that with the fewest edits, then the first; of parts the longest.
    """
    codes = folded(text)
    kept: dict[int, list[tuple[int, int, int, int]]] = {}

    def keep(found: list[tuple[int, int, int, int]]) -> None:
        for item, start, end, edits in found:
            own = kept.setdefault(item, [])
            if not any(start < k[2] and k[1] < end for k in own):
                own.append((item, start, end, edits))

    keep(short_items(codes, index))
    whole: list[tuple[int, int, int, int]] = []
    pieces: list[tuple] = []
    places: dict[int, list[tuple[int, int]]] = {}
    done: set[tuple[int, int]] = set()
    regions = list(index.regions(qgram_hashes(codes))) if len(codes) >= Q else []
    for entry, low, full in sorted(regions, key=lambda r: not index.whole[r[0]]):
        limit, size, item, band = int(index.edits[entry]), len(index.codes[entry]), index.owner[entry], int(index.band[entry])
        # places in neighbouring bands would overlap
        if {(entry, low - band), (entry, low + band)} & done:
            continue
        if not index.whole[entry] and any(full < b and a < full + size for a, b in places.get(item, ())):
            continue
        if full >= 0 and np.array_equal(codes[full : full + size], index.codes[entry]):
            best = 0, full, full + size
        else:
            # the band's diagonals, and those that edits before its first shared q-gram may take
            best = banded_edits(index.codes[entry], codes, low - limit, 2 * band + 2 * limit, limit)
        if best is None:
            continue
        done.add((entry, low))
        if index.whole[entry]:
            whole.append((item, best[1], best[2], best[0]))
            places.setdefault(item, []).append((best[1], best[2]))
        else:
            pieces.append((item, index.offset[entry], best[1], best[2], size, band))
    keep(sorted(whole, key=lambda x: (x[0], x[3], x[1])))
    keep(sorted(_part_ranges(pieces, codes, index), key=lambda x: (x[0], x[1] - x[2], x[3], x[1])))
    return [(index.ids[item], start, end, edits) for own in kept.values() for item, start, end, edits in own]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items (item_id, trimmed text) in blocks of at most BLOCK code points, or of one item."""
    items = benchmark.where("text IS NOT NULL").select("item_id", F.trim("text").alias("text")).where(F.length("text") > 0)
    block, size = [], 0
    for item_id, text in items.toLocalIterator():
        if block and size + len(text) > BLOCK:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


def _index(sent) -> Index:
    """This worker's index of a block, made when first needed."""
    return worker_kept(sent.value[0], lambda: Index(sent.value[1]))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row (doc_id, item_id, start, end, edits) for each passage of ``docs`` that is a benchmark item or part of one.

    An item is found where it stands within RATE edits a code point, upper and lower case and kinds of
    white space being alike; where it doesn't, its lines and windows are, by the same rule, and those that
    follow each other are one passage, whose edits are counted against that part of the item. start and end
    are code points of the text. Items of fewer than SHORTEST code points (trimmed) are found without edits
    and where no letter or digit adjoins. An item's result doesn't depend on the others. Of places of one item that
    overlap, the one with the fewest edits is told, of equal ones the first; all that don't overlap are. A very long
    text is searched as a whole, in memory of its size. Null texts and items hold nothing. Repeated rows and repeated items
    give repeated results; no documents or no items give none; other columns are left aside.
    """
    kind = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())]))
    whole = None
    for number, block in enumerate(blocks(benchmark)):
        name = f"{number}:{hash(tuple(block))}"
        sent = docs.sparkSession.sparkContext.broadcast((name, block))

        def values(texts, sent=sent):
            index = _index(sent)
            return [[[dict(zip(("item_id", "start", "end", "edits"), p, strict=True)) for p in passages(t or "", index)] for t in texts]]

        part = annotate(docs.select("doc_id", "text"), ["text"], [("found", kind)], values, key=name).select("doc_id", F.explode("found").alias("p")).select("doc_id", "p.*")
        whole = part if whole is None else whole.union(part)
    if whole is None:
        whole = docs.where("false").select("doc_id", F.lit(0).cast("bigint").alias("item_id"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"), F.lit(0).alias("edits"))
    return whole


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a passage that :func:`contaminated` finds; all columns pass."""
    for number, block in enumerate(blocks(benchmark)):
        name = f"{number}:{hash(tuple(block))}"
        sent = docs.sparkSession.sparkContext.broadcast((name, block))

        def values(texts, sent=sent):
            index = _index(sent)
            return [[not passages(t or "", index) for t in texts]]

        docs = annotate(docs, ["text"], [(fresh(docs, "clean"), T.BooleanType())], values, keep=0, key=name)
    return docs
