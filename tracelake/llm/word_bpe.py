"""BPE over words with an end mark, by speculation and verification.

For each new word the longest token at each place is proposed, greedily. A sequence of tokens is the result of merging
exactly when every token is and every neighbouring pair is the result of merging its own characters; so all neighbours of
all proposals of a batch are tested at once, as arrays: the edges that meet at the seam are walked back in time, and a pair
fails if a merge across the seam would have come first. Words with a failing pair are merged the long way.

The vocabulary file is that of the tokenizers library, with the parts that :class:`Vocabulary` names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.bpe import LATER_LETTERS, LATER_NUMBERS, WHITE, char_class
from tracelake.llm.common import for_texts, kept, tidy

#: Marks that Unicode has put in order since version 9.0, by which the compared library composes, and one half of a later composition.
LATER_MARKS = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B "
    "1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
#: Lower case since Unicode 15.1, as first:last:first of the small ones; and the small sigma, whose final form the compared library doesn't use.
LATER_LOWER = "1C89:1C89:1C8A A7CB:A7CB:0264 A7CC:A7CC:A7CD A7CE:A7CE:A7CF A7D2:A7D2:A7D3 A7D4:A7D4:A7D5 A7DA:A7DA:A7DB A7DC:A7DC:019B 10D50:10D65:10D70 16EA0:16EB8:16EBB 03A3:03A3:03C3"

#: Words in each of a worker's two tables, words of texts that are looked up together, and characters of a text whose words
#: are found at once. They change no result.
MAX_WORDS, TOGETHER, LONG = 200_000, 1 << 16, 1 << 20
NEVER = np.iinfo(np.int64).max
#: Stands for the end of a word behind its last character; no byte is shown as it.
END = "\0"


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones of Latin-1 for themselves, the others from U+0100 on in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    later = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(later)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and the way to split a text, from the JSON of a vocabulary file.

    Read are: added tokens (plain ones, cut out of the text as given), normalizers NFC, white space to a space and lower case; a
    splitting pattern whose matches stay; bytes as characters; BPE with an end-of-word suffix; no decoder. Other
    parts raise an error.
    """

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, parts = spec["model"], [*spec["normalizer"]["normalizers"], *spec["pre_tokenizer"]["pretokenizers"]]
        split, as_bytes = parts[-2], parts[-1]
        suffix = model["end_of_word_suffix"]
        kinds = [p["type"] for p in parts] == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")) and not any(a[k] for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if not (model["type"] == "BPE" and suffix and kinds and plain and parts[1]["pattern"] == {"Regex": r"\s+"} and split["behavior"] == "Removed" and split["invert"] and not as_bytes["add_prefix_space"] and not as_bytes["use_regex"] and not spec["decoder"]):
            raise ValueError("a vocabulary of another kind")
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else lambda text: [text]
        self._splitting(split["pattern"]["Regex"])
        self._merges(model, suffix)

    def _splitting(self, pattern: str) -> None:
        letters, numbers = ("".join(rf"\U{c:08x}" for c in range(0x250) if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
        # below U+0250 the classes are short enough for the standard library's faster matcher; all stand in brackets
        self.latin = re.compile(pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", WHITE))
        strict = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{char_class(LATER_LETTERS)}]]").replace(r"\p{N}", rf"[\p{{N}}--[{char_class(LATER_NUMBERS)}]]")
        self.usual, self.strict = regex.compile(pattern), regex.compile("(?V1)" + strict)
        self.beyond = re.compile("[^\\x00-\\u024f]").search
        self.later = re.compile(f"[{char_class(LATER_LETTERS + ' ' + LATER_NUMBERS)}]").search
        self.marks = re.compile(f"([{char_class(LATER_MARKS)}])")
        self.lower = {int(first, 16) + i: int(small, 16) + i for first, last, small in (x.split(":") for x in LATER_LOWER.split()) for i in range(int(last, 16) - int(first, 16) + 1)}
        self.odd = re.compile("[" + "".join(rf"\U{c:08x}" for c in self.lower) + "]").search

    def _merges(self, model: dict, suffix: str) -> None:
        shown = byte_characters()
        self.shown = str.maketrans({b: c for b, c in enumerate(shown)})
        inner = lambda token: token[: -len(suffix)] + END if token.endswith(suffix) else token
        vocab = {inner(token): i for token, i in model["vocab"].items()}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.text_of = [""] * size
        for token, i in [*model["vocab"].items(), *self.added.items()]:
            self.text_of[i] = token
        self.decimal = [str(i) for i in range(size)]
        if any(c + end not in vocab for c in shown for end in ("", END)):
            raise ValueError("a byte has no token")
        self.base = {c + end: vocab[c + end] for c in shown for end in ("", END)}
        self.joint: dict[tuple[int, int], tuple[int, int]] = {}
        #: When a token is complete (its merge's rank, -1 for single characters) and the two parts it was merged from.
        self.time, self.left, self.right = np.full(size, NEVER), np.full(size, -1), np.full(size, -1)
        self.time[list(self.base.values())] = -1
        again, late = set(), []
        for rank, pair in enumerate(model["merges"]):
            a, b = (vocab[inner(x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            made = vocab[inner(self.text_of[a] + self.text_of[b])]
            late.append(self.time[a] == NEVER or self.time[b] == NEVER)
            if self.time[made] != NEVER:
                again.add(made)
            else:
                self.time[made], self.left[made], self.right[made] = rank, a, b
            self.joint[a, b] = (rank, made)
        keys = np.array([a * size + b for a, b in self.joint], np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.ranks = size, keys[order], np.array([r for r, _ in self.joint.values()], np.int64)[order]
        # tokens to propose: those that merging makes of their own characters, in one way only, of parts that came before
        made = np.nonzero((self.time >= 0) & (self.time < NEVER))[0]
        held = self.fits(self.left[made], self.right[made], self.time[made]) if not any(late) else np.zeros(len(made), bool)
        sound = dict.fromkeys(self.base.values(), True)
        for t, ok in sorted(zip(made.tolist(), held.tolist(), strict=True), key=lambda x: self.time[x[0]]):
            sound[t] = ok and t not in again and sound.get(int(self.left[t]), False) and sound.get(int(self.right[t]), False)
        self.known = {token: i for token, i in vocab.items() if sound.get(i)}
        lengths: dict[str, set[int]] = {}
        for token in self.known:
            lengths.setdefault(token[:2], set()).add(len(token))
        self.lengths = {head: sorted(n, reverse=True) for head, n in lengths.items()}

    def rank_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Ranks of the merges of pairs, NEVER where there is none."""
        if not len(self.keys):
            return np.full(len(x), NEVER)
        want = x.astype(np.int64) * self.size + y
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NEVER)

    def fits(self, x: np.ndarray, y: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether each token of ``y`` may follow that of ``x``: no merge across the seam comes before the ones inside.

        The two tokens at the seam are as of ``until`` (the end of all merging, if not given). A merge of theirs fails the pair
        if it comes before either is merged on; of equal ranks the leftmost merge comes first. Then the later made of the two
        gives way to its part at the seam, and so on back to single characters.
        """
        x, y = x.copy(), y.copy()
        x_end = np.full(len(x), NEVER) if until is None else until.copy()
        y_end, good, live = x_end.copy(), np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            rank = self.rank_of(a, b)
            bad = (rank < x_end[live]) & (rank <= y_end[live])
            good[live[bad]] = False
            made_a, made_b = self.time[a], self.time[b]
            more = ~bad & ((made_a >= 0) | (made_b >= 0))
            back = made_a >= made_b
            one, two = live[more & back], live[more & ~back]
            x_end[one], x[one] = self.time[x[one]], self.right[x[one]]
            y_end[two], y[two] = self.time[y[two]], self.left[y[two]]
            live = live[more]
        return good

    def proposal(self, word: str) -> list[int] | None:
        """The longest known token at each place of a word whose end is marked; None where the parts run out."""
        at, end, out, known = 0, len(word), [], self.known
        while at < end:
            for n in self.lengths.get(word[at : at + 2], ()) or self.lengths.get(word[at], ()):
                if at + n <= end and at + n != end - 1 and (token := known.get(word[at : at + n])) is not None:
                    break
            else:
                token = known.get(word[at])
                n = 1
                if token is None or at == end - 2:
                    return None
            out.append(token)
            at += n
        return out

    def merged(self, word: str) -> list[int]:
        """The definition: the pair of lowest rank is merged, the leftmost of equals, until none has one."""
        tokens = [self.base[c] for c in word[:-2]] + [self.base[word[-2:]]]
        after, before, joint = list(range(1, len(tokens))) + [-1], list(range(-1, len(tokens) - 1)), self.joint
        queue = [(joint[p][0], i, *p) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in joint]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if tokens[i] != a or j < 0 or tokens[j] != b:
                continue
            tokens[i], tokens[j] = joint[a, b][1], -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (pair := (tokens[left], tokens[right])) in joint:
                    heapq.heappush(queue, (joint[pair][0], left, *pair))
        return [t for t in tokens if t >= 0]

    def encode_words(self, words: list[str], counted: list[int] | None = None) -> list[list[int]]:
        """Token ids of each word. ``counted`` gets how many were merged the long way."""
        marked = [w.encode().decode("latin-1").translate(self.shown) + END for w in words]
        found = [self.proposal(w) for w in marked]
        sizes = np.array([len(f) if f else 0 for f in found])
        flat = np.array([t for f in found if f for t in f], np.int64)
        if len(flat) > 1:
            word = np.repeat(np.arange(len(found)), sizes)
            inside = word[1:] == word[:-1]
            pair = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
            good = self.fits(pair[0] // self.size, pair[0] % self.size)[pair[1]]
            for k in np.unique(word[:-1][inside][~good]).tolist():
                found[k] = None
        if counted is not None:
            counted.append(sum(f is None for f in found))
        return [self.merged(w) if f is None else f for w, f in zip(marked, found, strict=True)]

    def normal(self, text: str) -> str:
        """NFC of Unicode 9.0, then lower case letter by letter. White space only divides words, so that it needn't become a space."""
        if text.isascii():
            return text.lower()
        if self.marks.search(text):
            text = "".join(p if i % 2 else unicodedata.normalize("NFC", p) for i, p in enumerate(self.marks.split(text)))
        else:
            text = unicodedata.normalize("NFC", text)
        return (text.translate(self.lower) if self.odd(text) else text).lower()

    def words(self, text: str) -> Iterator[list]:
        """The words of a text in order, in lists; an added token is a list of the one tuple of it."""
        for i, part in enumerate(self.cut(text)):
            if i % 2:
                yield [(part,)]
            elif part:
                part = self.normal(part)
                match = self.latin if not self.beyond(part) else self.strict if self.later(part) else self.usual
                if len(part) <= LONG:
                    yield match.findall(part)
                else:
                    found = match.finditer(part)
                    while words := [m[0] for m in islice(found, TOGETHER)]:
                        yield words


class Codec:
    """Encodes and decodes texts, and remembers a bounded number of words.

    Words met since the younger table was begun are in it; when it is full it becomes the older one, whose words come
    back when they are met again. So what is frequent stays, whatever comes between.
    """

    def __init__(self, data: bytes):
        self.own = Vocabulary(data)
        self.added = {(a,): np.array([i], np.uint32).tobytes() for a, i in self.own.added.items()}
        self.young: dict = dict(self.added)
        self.old: dict = {}

    def _learn(self, words: set) -> None:
        young, old = self.young, self.old
        if len(young) > MAX_WORDS:
            self.old, self.young = old, young = young, dict(self.added)
        new = []
        for word in words:
            if word not in young:
                if (ids := old.get(word)) is not None:
                    young[word] = ids
                else:
                    new.append(word)
        found = self.own.encode_words(new)
        packed = np.fromiter(chain.from_iterable(found), np.uint32).tobytes()
        at = 0
        for word, ids in zip(new, found, strict=True):
            young[word] = packed[at : (at := at + 4 * len(ids))]

    def encode(self, texts: list[str]) -> Iterator[tuple[int, list[int]]]:
        """(number of the text, token ids that follow), some TOGETHER words at a time, long texts in several pieces."""
        held: list[tuple[int, list]] = []
        count = 0
        for k, text in enumerate(texts):
            for words in self.own.words(text):
                held.append((k, words))
                count += len(words)
                if count >= TOGETHER:
                    yield from self._told(held)
                    held, count = [], 0
        yield from self._told(held)

    def _told(self, held: list[tuple[int, list]]) -> Iterator[tuple[int, list[int]]]:
        self._learn(set().union(*(words for _, words in held)))
        look = self.young.__getitem__
        for k, words in held:
            yield k, np.frombuffer(b"".join(map(look, words)), np.uint32).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens as they stand, with a space between."""
        return " ".join(map(self.own.text_of.__getitem__, ids))


class _Joined:
    """SHA-256 of pieces with a space between."""

    def __init__(self):
        self.sum, self.empty = hashlib.sha256(), True

    def add(self, piece: str) -> None:
        self.sum.update(("" if self.empty else " ").encode() + piece.encode())
        self.empty = False


def encode_documents(docs: DataFrame, path: str, *, text: str = "text", keep: Iterable[str] = ("doc_id",), digests: bool = True) -> DataFrame:
    """Encode and decode the whole of column ``text`` of every row.

    Returns the columns ``keep`` and ``n_tokens``; with ``digests`` ``ids_sha256`` and ``decoded_sha256``, else ``token_ids``
    (array of int) and ``decoded`` (string). Null text is an empty text: no tokens. Rows are independent: repeated rows
    give repeated results, an empty table none, other columns are left aside. The vocabulary file (a fixed public file of
    some 2 MB) is read on the driver and sent out.
    """
    spark = docs.sparkSession
    for_texts(spark)
    with open(path, "rb") as file:
        data = file.read()
    key = ("words", hashlib.sha256(data).hexdigest())
    sent = spark.sparkContext.broadcast(data)
    keep = list(keep)
    kinds = dict(zip(docs.columns, docs.schema.fields, strict=True))
    source = docs.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    made = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")] if digests else [("n_tokens", "bigint"), ("token_ids", "array<int>"), ("decoded", "string")]
    schema = ", ".join([f"k{i} {kinds[k].dataType.simpleString()}" for i, k in enumerate(keep)] + [f"{n} {t}" for n, t in made])

    def run(batches):
        own = kept(key, lambda: Codec(sent.value))
        for batch in batches:
            n = [0] * batch.num_rows
            first: list = [_Joined() if digests else [] for _ in n]
            second: list = [_Joined() for _ in n] if digests else []
            for k, ids in own.encode(batch.column(len(keep)).to_pylist()):
                n[k] += len(ids)
                if not digests:
                    first[k] += ids
                elif ids:
                    first[k].add(" ".join(map(own.own.decimal.__getitem__, ids)))
                    second[k].add(own.decode(ids))
            if digests:
                first, second = [x.sum.hexdigest() for x in first], [x.sum.hexdigest() for x in second]
            else:
                second = [own.decode(ids) for ids in first]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(first, pa.string() if digests else pa.list_(pa.int32())), pa.array(second, pa.string())], names=[*batch.schema.names[: len(keep)], *[x for x, _ in made]])

    return source.mapInArrow(tidy(run, key), schema).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], *[x for x, _ in made])
