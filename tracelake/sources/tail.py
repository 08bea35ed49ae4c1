"""A streaming source of growing text files: offsets are bytes read of each file, up to the last line end.

Spark's own file stream takes files as finished; this one reads what has been appended since, exactly
once, and leaves an unended line for the next batch. The offset of a file holds a mark of what was read: the digests of its first
bytes and of the last bytes before the offset. A file whose bytes no longer fit its mark (truncated, written anew, replaced by
another) is read from its start; a file of a new name that fits the mark of one that is gone was renamed, and goes on where
that one stood. Folders may be any URI that pyarrow's file systems know (local, hdfs, s3, gs); driver and executors must
both reach them. Bytes that were cut off before a planned batch was read are gone: the batch then has what is left.
"""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, start bigint, line string"
MARK = 1024  # bytes of a digest at either end
BLOCK = 1 << 20

log = logging.getLogger(__name__)


class Span(InputPartition):
    """Lines of a file that begin in [start, end); ``own`` says whether one begins at start, ``limit`` where the batch ends."""

    def __init__(self, name: str, path: str, start: int, end: int, own: bool = True, limit: int | None = None):
        self.name, self.path, self.start, self.end, self.own, self.limit = name, path, start, end, own, end if limit is None else limit


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.suffix, self.span = options.get("suffix", ".jsonl"), int(options.get("spanbytes") or options.get("spanBytes") or 64 << 20)
        self.store, self.folder = place(options["path"])
        self.known: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def files(self) -> dict[str, fs.FileInfo]:
        found = self.store.get_file_info(fs.FileSelector(self.folder, recursive=True, allow_not_found=True))
        return {f.path: f for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(self.suffix)}

    def latestOffset(self) -> dict:
        """Marks of all files as they are; a file of the same size and time as before isn't opened again."""
        found, marks = self.files(), {}
        for path, info in found.items():
            seen = (info.size, info.mtime_ns)
            if self.known.get(path, (None,))[0] != seen:
                try:
                    self.known[path] = (seen, self.mark(path))
                except FileNotFoundError:
                    continue  # gone since it was listed
            marks[path] = self.known[path][1]
        self.known = {p: k for p, k in self.known.items() if p in found}
        return {"files": json.dumps(marks, sort_keys=True)}

    def mark(self, path: str) -> list:
        """[bytes up to and with the last line feed, digest of the first MARK of them, digest of the last MARK of them]."""
        with self.store.open_input_file(path) as file:
            end = self.complete(file)
            return [end, *self.digests(file, end)]

    @staticmethod
    def complete(file, block: int = 1 << 16) -> int:
        """Bytes up to and with the last line feed, looked for from the end."""
        at = file.size()
        while at > 0:
            start = max(0, at - block)
            found = file.read_at(at - start, start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            at = start
        return 0

    @staticmethod
    def digests(file, end: int) -> list[str]:
        size = min(MARK, end)
        return [hashlib.sha256(file.read_at(size, at)).hexdigest()[:32] for at in (0, end - size)]

    def fits(self, path: str, mark: list) -> bool:
        """Whether the file still has the bytes that the mark is of."""
        try:
            with self.store.open_input_file(path) as file:
                return file.size() >= mark[0] and self.digests(file, mark[0]) == list(mark[1:])
        except FileNotFoundError:
            return False

    def partitions(self, start: dict, end: dict) -> list[Span]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        now, begin = {}, {}
        for path, mark in after.items():
            if before.get(path) != mark:
                now[path] = self.current(path, mark)
                if now[path] is None:
                    log.warning("%s is gone before its lines up to byte %d were read", path, mark[0])
        now = {p: f for p, f in now.items() if f is not None}
        for path, found in now.items():
            if path in before and before[path][0] <= after[path][0] and self.fits(found, before[path]):
                begin[path] = before[path][0]
        # what was read of files that are gone from their names, the longest first: one may have been renamed, or rotated away
        moved = sorted((p for p, m in before.items() if m[0] > 0 and p not in begin and after.get(p) != m), key=lambda p: (-before[p][0], p))
        for path, found in now.items():
            if path not in begin:
                other = next((p for p in moved if before[p][0] <= after[path][0] and self.fits(found, before[p])), None)
                begin[path] = 0 if other is None else before[other][0]
                if other is not None:
                    moved.remove(other)
        spans = []
        for path, found in now.items():
            cuts = [*range(begin[path], after[path][0], self.span), after[path][0]]
            spans += [Span(path, found, a, b, a == begin[path], after[path][0]) for a, b in zip(cuts, cuts[1:])]
        return spans

    def current(self, path: str, mark: list) -> str | None:
        """Where the planned file is now: at its path if it is there, else at that of a file that fits its mark."""
        if self.store.get_file_info(path).type == fs.FileType.File:
            return path
        return next((p for p in self.files() if mark[0] and self.fits(p, mark)), None)

    def read(self, partition: Span) -> Iterator[tuple]:
        """Block by block: no more than a block and a line is held."""
        with self.store.open_input_file(partition.path) as file:
            limit = min(partition.limit, file.size())
            at = partition.start if partition.own else partition.start - 1
            rest, begin, skip = b"", at, not partition.own
            while begin < partition.end and at < limit:
                block = file.read_at(min(BLOCK, limit - at), at)
                at += len(block)
                *lines, rest = (rest + block).split(b"\n") if b"\n" in block else [rest + block]
                for raw in lines:
                    if begin >= partition.end:
                        return
                    if not skip and raw.strip():
                        yield (partition.name, begin, raw.decode("utf-8", "replace"))
                    skip = False
                    begin += len(raw) + 1

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)
