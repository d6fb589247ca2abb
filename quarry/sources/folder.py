"""Folders on a file system: checked reads, and a stream of what changes in a folder."""

from __future__ import annotations

import json
import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from quarry.functions.text import truncate_bytes
from quarry.sources.files import ALWAYS_EXCLUDED, EXCLUDED

MOST_TEXT = 1 << 20


@dataclass(frozen=True)
class Refused:
    """Why a file was not read: multi-linked, not-plain or too-large."""

    reason: str


def read_checked(path: str, cap: int = MOST_TEXT) -> bytes | Refused:
    """The bytes of a plain file with one name. Symbolic links are not followed, and what was opened is what is judged."""
    try:
        handle = os.open(path, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK)
    except OSError as error:
        if os.path.islink(path):
            return Refused("not-plain")
        raise error
    try:
        s = os.fstat(handle)
        if not stat.S_ISREG(s.st_mode):
            return Refused("not-plain")
        if s.st_nlink > 1:
            return Refused("multi-linked")
        with os.fdopen(os.dup(handle), "rb") as f:
            raw = f.read(cap + 1)
        return Refused("too-large") if len(raw) > cap else raw
    finally:
        os.close(handle)


def walk(root: str, extensions: tuple[str, ...] = ("md",), folders: tuple[str, ...] | None = None) -> Iterator[tuple[str, os.stat_result]]:
    """(path below root, stat) of the eligible files, in path order: of a registered extension, with one name, no link and no lock file, outside the excluded folders."""
    barred = {x.lower() for x in (*ALWAYS_EXCLUDED, *(EXCLUDED if folders is None else folders))}
    pending, out = [""], []
    while pending:
        below = pending.pop()
        with os.scandir(os.path.join(root, below)) as entries:
            for e in entries:
                name = f"{below}/{e.name}".lstrip("/")
                if e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    if e.name.lower() not in barred:
                        pending.append(name)
                elif e.is_file(follow_symlinks=False) and not e.name.startswith("~$") and os.path.splitext(e.name)[1][1:].lower() in extensions:
                    s = e.stat(follow_symlinks=False)
                    if s.st_nlink == 1:
                        out.append((name, s))
    yield from sorted(out, key=lambda x: x[0])


def document_text(root: str, path: str, extensions: tuple[str, ...] = ("md",), cap: int = MOST_TEXT, most: int = 50 << 20) -> tuple[str, bool] | Refused:
    """(text, whether it was cut) of one document below root; refused if the path leaves root, passes a link or has no registered extension."""
    base = os.path.realpath(root)
    full = os.path.join(base, path)
    if os.path.realpath(full) != os.path.normpath(full) or os.path.commonpath([base, os.path.realpath(full)]) != base:
        return Refused("not-plain")
    if os.path.splitext(path)[1][1:].lower() not in extensions:
        return Refused("extension")
    raw = read_checked(full, most)
    return raw if isinstance(raw, Refused) else (truncate_bytes(raw[: cap + 4].decode("utf-8", "ignore"), cap), len(raw) > cap)


def changes(old: dict[str, list], new: dict[str, list]) -> list[tuple[str, str, str | None]]:
    """(kind, path, new_path) between two snapshots {path: [inode, size, mtime]}: a file that has another name is renamed, others are reindexed or deindexed."""
    gone = {tuple(v): p for p, v in old.items() if p not in new}
    out, moved = [], set()
    for p, v in new.items():
        if p not in old and tuple(v) in gone:
            before = gone.pop(tuple(v))
            moved.add(before)
            out.append(("rename", before, p))
        elif old.get(p) != v:
            out.append(("reindex", p, None))
    return out + [("deindex", p, None) for p in old if p not in new and p not in moved]


class FolderReader(SimpleDataSourceStreamReader):
    """Offsets hold the folder's snapshot, so that a batch can be read again, and nothing is dropped however many files change."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.extensions = tuple(options.get("extensions", "md").split(","))
        self.folders = tuple(options["folders"].split(",")) if "folders" in options else None

    def initialOffset(self) -> dict:
        return {"batch": 0, "files": "{}"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        found = {p: [s.st_ino, s.st_size, s.st_mtime_ns] for p, s in walk(self.root, self.extensions, self.folders)}
        same = found == json.loads(start["files"])
        end = start if same else {"batch": start["batch"] + 1, "files": json.dumps(found, sort_keys=True)}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        import datetime

        before, after = json.loads(start["files"]), json.loads(end["files"])
        newest = max((v[2] for v in after.values()), default=0)  # when a deletion happened isn't known; it comes after what is there
        out = []
        for k, (kind, path, new_path) in enumerate(changes(before, after)):
            at = max(newest, before.get(path, [0, 0, 0])[2]) if kind != "reindex" else after[path][2]
            out.append((end["batch"] * 1_000_000_000 + k, datetime.datetime.fromtimestamp(at / 1e9, datetime.UTC), kind, path, new_path))
        return iter(out)  # a list's iterator can be sent between processes


class FolderSource(DataSource):
    """spark.dataSource.register(FolderSource), then readStream.format("quarry_folder").option("path", root): file events for streaming.maintain."""

    @classmethod
    def name(cls) -> str:
        return "quarry_folder"

    def schema(self) -> str:
        return "event_id long, ts timestamp, kind string, path string, new_path string"

    def simpleStreamReader(self, schema) -> FolderReader:
        return FolderReader(self.options)
