"""Listing and opening of files, one row per file.

Spark's own file sources skip names that start with ``_`` or ``.`` and read ``{}`` in
names as patterns.  Mail folders have such names, so the folders are walked here, in tasks:
neither names nor contents pass through the driver.  A task that has listed its share
hands the folders it has not entered to the next round, which spreads them again; a folder with very many names is handed on
in slices of its names, which several tasks list, each holding its own names alone.
"""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice
from urllib.parse import quote, unquote_to_bytes

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailbench.session import parallelism, stage

LISTED_ROWS = 10_000
WALKED_ENTRIES = 20_000
SPLIT_ENTRIES = 100_000  # names in one folder that one task lists
SLICES = 16
CONTENT_BYTES = 32 << 20
ATTEMPTS, PAUSE_SEC = 4, 1.0

# Missing, forbidden or no folder at all: nothing that another attempt would find.
PASSED_OVER = (FileNotFoundError, PermissionError, NotADirectoryError, IsADirectoryError)
RAW = "raw-path:"


def as_text(path: str) -> str:
    """A path as valid text: names that are not UTF-8 are written as quoted bytes."""
    try:
        path.encode("utf-8")
        return path
    except UnicodeEncodeError:
        return RAW + quote(os.fsencode(path))


def attempted(action: Callable):
    """The action's result; other errors than those above are tried again, then raised."""
    for left in reversed(range(ATTEMPTS)):
        try:
            return action()
        except PASSED_OVER:
            raise
        except OSError:
            if not left:
                raise
            time.sleep(PAUSE_SEC * (ATTEMPTS - left))


class Stores:
    """Finds the file system of a path; made once per task, where it keeps its connections."""

    def __init__(self):
        self._opened: dict[str, fs.FileSystem] = {}

    def locate(self, path: str) -> tuple[fs.FileSystem | None, str]:
        """File system and path in it; None for a path of the mounted file tree."""
        if path.startswith(RAW):
            return None, os.fsdecode(unquote_to_bytes(path.removeprefix(RAW)))
        if path.startswith("file:"):
            return None, "/" + path.removeprefix("file:").lstrip("/")
        scheme, found, rest = path.partition("://")
        if not found:
            return None, path
        host, _, below = rest.partition("/")
        root = f"{scheme.replace('s3a', 's3')}://{host}"
        if root not in self._opened:
            self._opened[root] = fs.FileSystem.from_uri(root)[0]
        # Object stores count the bucket as part of the path, file systems do not.
        return self._opened[root], f"/{below}" if scheme == "hdfs" else rest

    def read(self, path: str) -> bytes:
        store, inside = self.locate(path)
        with open(inside, "rb") if store is None else store.open_input_stream(inside) as stream:
            return stream.read()

    def open(self, path: str):
        """A file to seek in."""
        store, inside = self.locate(path)
        return open(inside, "rb") if store is None else store.open_input_file(inside)

    def write(self, path: str, content: bytes) -> None:
        store, inside = self.locate(path)
        folder = inside.rpartition("/")[0]
        if store is None:
            os.makedirs(folder, exist_ok=True)
            opened = open(inside, "wb")
        else:
            store.create_dir(folder, recursive=True)
            opened = store.open_output_stream(inside)
        with opened as stream:
            stream.write(content)

    def children(self, folder: str) -> Iterator[tuple[str, bool]]:
        """Path of everything directly in a folder, and whether it is a folder to walk into."""
        store, inside = self.locate(folder)
        base = folder.rstrip("/")
        if store is None:
            with os.scandir(inside) as entries:
                for entry in entries:
                    name = as_text(f"{inside.rstrip('/') if base.startswith(RAW) else base}/{entry.name}")
                    if not entry.is_dir():
                        yield name, False
                    elif not entry.is_symlink():
                        yield name, True
        else:
            for info in store.get_file_info(fs.FileSelector(inside)):
                yield f"{base}/{info.base_name}", info.type == fs.FileType.Directory

    def readable(self, folder: str) -> Iterator[tuple[str, bool]]:
        """The children; none if the folder is missing or forbidden.  Any other error ends the job, not the list."""
        try:
            yield from attempted(lambda: list(self.children(folder)))
        except PASSED_OVER:
            return

    def slice_of(self, folder: str, part: int = 0, parts: int = 1, most: int | None = None) -> list[tuple[str, bool]] | None:
        """The children whose names fall in one of ``parts`` slices; None if they are more than ``most``.

        A slice is chosen by the name alone, so the slices of a folder are apart and together all of it, whoever lists them and
        in whatever order the names come.  No more than ``most`` names are held.
        """
        def names():
            own = (child for child in self.children(folder) if parts == 1 or _slice(child[0], parts) == part)
            return list(own if most is None else islice(own, most + 1))

        try:
            found = attempted(names)
        except PASSED_OVER:
            return []
        return None if most is not None and len(found) > most else found


def _slice(path: str, parts: int) -> int:
    return zlib.crc32(path.rpartition("/")[2].encode()) % parts


def _list_folders(batches: Iterator[pd.DataFrame], descend: bool = True) -> Iterator[pd.DataFrame]:
    """Walk each folder; once it has yielded a share of entries, hand its other subfolders on.

    A folder of more than ``SPLIT_ENTRIES`` names is not listed but handed on in slices of its names, and so is a slice
    that is still too large.  Without ``descend`` subfolders are left out.
    """
    stores = Stores()
    columns = ["path", "is_folder", "part", "parts"]
    rows: list[tuple[str, bool, int, int]] = []
    for batch in batches:
        given = batch.reindex(columns=["path", "part", "parts"]).fillna({"part": 0, "parts": 1})
        for start in given.itertuples(index=False):
            waiting, share = [(start.path, int(start.part), int(start.parts))], 0
            while waiting:
                if share >= WALKED_ENTRIES:
                    rows += [(path, True, part, parts) for path, part, parts in waiting]
                    break
                folder, part, parts = waiting.pop()
                found = stores.slice_of(folder, part, parts, SPLIT_ENTRIES)
                if found is None:
                    rows += [(folder, True, part + parts * i, parts * SLICES) for i in range(SLICES)]
                    share += SPLIT_ENTRIES
                    continue
                for path, is_folder in found:
                    share += 1
                    if not is_folder:
                        rows.append((path, False, 0, 1))
                    elif descend:
                        waiting.append((path, 0, 1))
                    if len(rows) >= LISTED_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
    yield pd.DataFrame(rows, columns=columns)


def _walk(spark: SparkSession, folders: tuple[str, ...], descend: bool) -> DataFrame:
    """``path`` of files, by rounds: one job each, and each a staged table from which the next starts."""
    rounds = []
    left, waiting = len(folders), spark.createDataFrame([(f, 0, 1) for f in folders], "path string, part long, parts long")
    while left:
        tasks = min(left, parallelism(spark))
        walked = waiting.repartition(tasks).mapInPandas(
            lambda batches: _list_folders(batches, descend), "path string, is_folder boolean, part long, parts long")
        found = stage(walked, "listing")
        rounds.append(found.filter(~F.col("is_folder")).select("path"))
        waiting = found.filter("is_folder").select("path", "part", "parts")
        left = waiting.count()
    return reduce(DataFrame.union, rounds)


def list_folder(spark: SparkSession, *folders: str) -> DataFrame:
    """``path`` of the files directly in the given folders; missing folders hold none.

    The listing is a staged table, so limits and readers see the same files.  A folder of many files is listed by several tasks.
    """
    return _walk(spark, folders, descend=False)


def list_mail_paths(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of every file at any depth under ``root``, whatever its name.

    One job per round; each round is a staged table, so the next starts from it.
    """
    return _walk(spark, (root,), descend=True)


def open_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Task side: ``path`` to ``path, content``, in batches bounded by bytes.

    Files that are gone or forbidden are left out; other errors are tried again and then end the job.
    """
    stores = Stores()
    rows: list[tuple[str, bytes]] = []
    held = 0
    for batch in batches:
        for path in batch["path"]:
            try:
                content = attempted(lambda: stores.read(path))
            except PASSED_OVER:
                continue
            rows.append((path, content))
            held += len(content)
            if held >= CONTENT_BYTES:
                yield pd.DataFrame(rows, columns=["path", "content"])
                rows, held = [], 0
    yield pd.DataFrame(rows, columns=["path", "content"])


def spread_paths(paths: DataFrame, partitions: int | None = None) -> DataFrame:
    """Paths dealt out evenly: few bytes, but each stands for a file to open."""
    return paths.select("path").repartition(partitions or parallelism(paths.sparkSession))


def read_files(paths: DataFrame, partitions: int | None = None) -> DataFrame:
    """``path, content`` of the files listed in ``paths``, opened where they are processed."""
    return spread_paths(paths, partitions).mapInPandas(open_files, "path string, content binary")
