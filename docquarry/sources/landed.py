"""Landed listings as a data source: a folder of filing listings, one JSON file an entity and day, read in parallel, in batches or as a stream.

    spark.dataSource.register(ListingSource)
    spark.read.format("landed_listings").load(folder).where("day >= '2024-01-01' and form = '10-K'")

Files lie under ``day=YYYY-MM-DD/``; each holds the parallel arrays of a listing. Comparisons of ``day`` with a literal are pushed into the
listing of files, so that other days aren't opened; equality of ``form`` is pushed into their reading. A stream's offset is the last day
and file that was read. Files are reached by ``pyarrow.fs``, so the folder is a path or URI of a store that it knows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

COLUMNS = ("entity", "day", "form", "accession", "document", "accepted")
SCHEMA = "entity string, day string, form string, accession string, document string, accepted string"
_FIELDS = {"form": "form", "accession": "accessionNumber", "document": "primaryDocument", "accepted": "acceptanceDateTime"}
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class Files(InputPartition):
    """The files that one task reads."""

    def __init__(self, paths: list[tuple[str, str]]):
        self.paths = paths


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _listing(folder: str, keep=lambda day: True) -> list[tuple[str, str]]:
    """(day, path) of every file, ascending. Folders of days that aren't kept aren't listed."""
    from pyarrow import fs

    store, root = _open(folder)
    days = [f for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.Directory and f.base_name.startswith("day=") and keep(f.base_name[4:])]
    return sorted((d.base_name[4:], f.path) for d in days for f in store.get_file_info(fs.FileSelector(d.path)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def _rows(folder: str, paths: list[tuple[str, str]], form: str | None) -> Iterator[tuple]:
    """A row a filing. Arrays of unequal length are an error; blank accessions, documents and times are left out."""
    store, _ = _open(folder)
    for day, path in paths:
        with store.open_input_stream(path) as f:
            text = f.read().decode()
        for line in filter(str.strip, text.split("\n")):
            listing = json.loads(line)
            arrays = [listing["filings"]["recent"][k] for k in _FIELDS.values()]
            if len({len(a) for a in arrays}) > 1:
                raise ValueError(f"unequal arrays in {path}")
            for filing in zip(*arrays):
                if all(filing[1:]) and (form is None or filing[0] == form):
                    yield (listing["entity"], day, *filing)


class ListingReader(DataSourceReader):
    """Files dealt to ``tasks`` partitions, those of one day next to each other."""

    def __init__(self, folder: str, tasks: int):
        self.folder, self.tasks, self.days, self.form = folder, tasks, [], None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and f.attribute == ("day",):
                self.days.append(f)
            elif isinstance(f, EqualTo) and f.attribute == ("form",) and self.form is None:
                self.form = f.value
            else:
                yield f  # Spark applies what stays

    def partitions(self) -> list[Files]:
        found = _listing(self.folder, lambda day: all(_TESTS[type(f)](day, f.value) for f in self.days))
        size = max(1, -(-len(found) // self.tasks))
        return [Files(found[i : i + size]) for i in range(0, len(found), size)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.folder, partition.paths, self.form)


class ListingStream(DataSourceStreamReader):
    """New files in order of day and path. An offset names the last one read, so a file that lands under an earlier day isn't seen."""

    def __init__(self, folder: str, tasks: int):
        self.folder, self.tasks = folder, tasks

    def initialOffset(self) -> dict:
        return {"day": "", "path": ""}

    def latestOffset(self) -> dict:
        found = _listing(self.folder)
        return dict(zip(("day", "path"), found[-1])) if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        found = [x for x in _listing(self.folder, lambda day: start["day"] <= day <= end["day"]) if (start["day"], start["path"]) < x <= (end["day"], end["path"])]
        size = max(1, -(-len(found) // self.tasks))
        return [Files(found[i : i + size]) for i in range(0, len(found), size)]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.folder, partition.paths, None)

    def commit(self, end: dict) -> None:
        pass


class ListingSource(DataSource):
    """``path``: the folder. ``tasks``: how many partitions a batch is read in, at most (64)."""

    @classmethod
    def name(cls) -> str:
        return "landed_listings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"], int(self.options.get("tasks", 64)))

    def streamReader(self, schema) -> ListingStream:
        return ListingStream(self.options["path"], int(self.options.get("tasks", 64)))
