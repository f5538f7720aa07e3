"""Pieces shared by the training-data operators."""

from __future__ import annotations

import re
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    # this module travels with the functions that workers run; a session cannot
    from fieldloom.session import Workspace

#: Cut a text into pieces within which no match of the byte-level pre-token
#: pattern crosses an edge: a word with its one leading space, or blank runs.
COARSE = re.compile(r" ?\S+|\s+(?!\S)|\s")
#: Characters on which regex engines disagree about blankness.
UNSURE_BLANKS = re.compile("[\x1c-\x1f\x85]")
#: Characters of text that are handled at a time within one Arrow batch.
SLICE_CHARS = 2_000_000


def per_process(key: str, make: Callable[[], object]) -> object:
    """make(), kept in this Python process until another key is asked for, so that reused workers keep a memo.

    What make() itself asks for is kept along with it. Only one operator's
    tables are held at a time, whatever ran in the worker before.
    """
    store = sys.modules.setdefault("_fieldloom_store", types.ModuleType("_fieldloom_store")).__dict__
    if key not in store:
        for old in [k for k in store if not k.startswith("__")]:
            del store[old]
        store[key] = make()
    return store[key]


def per_process_child(key: str, make: Callable[[], object]) -> object:
    """make(), kept in this Python process beside whatever per_process() holds: for small things only."""
    store = sys.modules.setdefault("_fieldloom_small", types.ModuleType("_fieldloom_small")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker gives back the memory that its last partition needed; its memos stay."""

    def tidied(batches: Iterator) -> Iterator:
        import ctypes

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return tidied


class Memo(dict):
    """A dict of bounded size that keeps what was used of late; only speed depends on it.

    When half the bound is reached, the entries become the old half and those
    that are asked for again move back; what is not asked for goes with the next
    turn.
    """

    def __init__(self, bound: int = 800_000):
        super().__init__()
        self.half, self.old = bound // 2, {}

    def learn(self, keys: Iterable, values: Callable[[list], Iterable]) -> None:
        """Fill in what is missing of keys, by values(missing keys)."""
        missing = [k for k in keys if k not in self]
        if len(self) + len(missing) > self.half:
            self.old = dict(self)
            self.clear()
            missing = list(keys)
        old = self.old
        new = []
        for k in missing:
            if k in old:
                self[k] = old[k]
            else:
                new.append(k)
        if new:
            self.update(zip(new, values(new), strict=True))


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Index ranges of about SLICE_CHARS characters each; every range holds a row at least."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def read_file(uri: str) -> bytes:
    """A whole file of the shared folder."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        return f.read()


def show(fs: pafs.FileSystem, part: str, path: str) -> None:
    """Give a finished file its name in one move; where a former try of the same task has done so, drop the file."""
    try:
        fs.move(part, path)
    except OSError:
        if fs.get_file_info(path).type != pafs.FileType.File:
            raise
        fs.delete_file(part)


def write_file(uri: str, data: bytes) -> None:
    """Write a file of the shared folder; a retried task writes the same file and does no harm."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(part := f"{path}.{uuid.uuid4().hex}") as f:
        f.write(data)
    show(fs, part, path)


def named(name: str) -> Column:
    """The column of exactly this name, whatever dots or marks it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(docs: DataFrame, work: Workspace) -> DataFrame:
    """docs written once, with its columns renamed by place to c0, c1, ... and a row_id unique to each row.

    Working columns can then clash with none of docs' own; restored() undoes it.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return work.save(plain.withColumn("row_id", F.monotonically_increasing_id()), "numbered")


def place(docs: DataFrame, name: str) -> Column:
    """The column of docs in its numbered() form."""
    return F.col(f"c{docs.columns.index(name)}")


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of numbered() with docs' columns under their own names."""
    return rows.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)
