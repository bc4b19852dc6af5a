"""A streaming source of files that are new or were rewritten, which Spark's own file source hands over once only."""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, modified timestamp, length long, change string, content binary"


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


class _File(InputPartition):
    def __init__(self, path: str, modified_ns: int, length: int, change: str):
        self.path, self.modified_ns, self.length, self.change = path, modified_ns, length, change


class ChangedFiles(DataSource):
    """``spark.readStream.format("changed_files").option("log", folder).load(path)``: one row per new or rewritten file.

    A file is handed over again whenever its modification time differs from the last one seen, also where it is older,
    as a file that is moved into the folder may be. Options: ``suffix`` (files whose names end so; default all),
    ``log`` (a folder of this stream alone, outside of ``path``, that outlives restarts), ``content`` ("false": the
    content stays null).

    An offset is a number: the changes up to it are in the log, one small JSON file for each listing that found any,
    and every ``COMPACT`` of them a whole snapshot. So offsets do not grow with the folder, a restarted stream replays
    exactly the changes it had planned, and compares with what it saw last.
    """

    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):
        return ChangedFilesReader(self.options)


class ChangedFilesReader(DataSourceStreamReader):
    COMPACT = 20

    def __init__(self, options):
        self.suffix, self.content = options.get("suffix", ""), options.get("content", "true") == "true"
        if not options.get("log"):
            raise ValueError("changed_files needs a folder for its log")
        self.path, self.log = options["path"], options["log"].rstrip("/")
        self._known: dict[str, int] | None = None
        self._last = 0

    # the log

    def _store(self):
        store, folder = _opened(self.log)
        return store, folder

    def _entry(self, n: int) -> dict | None:
        store, folder = self._store()
        try:
            with store.open_input_stream(f"{folder}/{n}.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def _restore(self) -> None:
        """The files known at the end of the log: the last snapshot and the changes after it."""
        from pyarrow import fs

        store, folder = self._store()
        store.create_dir(folder, recursive=True)
        numbers = sorted(int(i.base_name[:-5]) for i in store.get_file_info(fs.FileSelector(folder)) if i.base_name[:-5].isdigit() and i.base_name.endswith(".json"))
        known: dict[str, int] = {}
        snapshots = [n for n in numbers if n % self.COMPACT == 0]
        for n in [m for m in numbers if not snapshots or m >= snapshots[-1]]:
            entry = self._entry(n)
            known = dict(entry["snapshot"]) if entry.get("snapshot") is not None else known
            known.update({c[0]: c[1] for c in entry["changes"]})
            for gone in entry["gone"]:
                known.pop(gone, None)
        self._known, self._last = known, numbers[-1] if numbers else 0

    # the stream

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        if self._known is None:
            self._restore()
        store, folder = _opened(self.path)
        listed = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        seen = {i.path: (i.mtime_ns or 0, i.size) for i in listed if i.type == fs.FileType.File and i.base_name.endswith(self.suffix) and not i.base_name.startswith((".", "_"))}
        changes = [(p, t, size, "modified" if p in self._known else "new") for p, (t, size) in sorted(seen.items()) if self._known.get(p) != t]
        gone = [p for p in self._known if p not in seen]
        if changes or gone:
            after = {p: t for p, (t, _) in seen.items()}
            n = self._last + 1
            entry = {"changes": changes, "gone": gone, "snapshot": sorted(after.items()) if n % self.COMPACT == 0 else None}
            log, to = self._store()
            with log.open_output_stream(f"{to}/.{n}.json") as f:
                f.write(json.dumps(entry).encode())
            log.move(f"{to}/.{n}.json", f"{to}/{n}.json")  # an entry is there whole or not at all
            self._known, self._last = after, n
        return {"n": self._last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        entries = [self._entry(n) for n in range(start["n"] + 1, end["n"] + 1)]
        return [_File(*c) for e in entries if e for c in e["changes"]]

    def read(self, partition: _File):
        from datetime import UTC, datetime

        data = None
        if self.content:
            store, _ = _opened(self.path)
            try:
                with store.open_input_stream(partition.path) as f:
                    data = f.read()
            except FileNotFoundError:
                return  # it went meanwhile; the next listing says so
        yield (partition.path, datetime.fromtimestamp(partition.modified_ns / 1e9, UTC), partition.length, partition.change, data)

    def commit(self, end: dict) -> None:
        """Entries before the last snapshot that ``end`` has passed are not needed any more."""
        from pyarrow import fs

        keep = end["n"] // self.COMPACT * self.COMPACT
        store, folder = self._store()
        for info in store.get_file_info(fs.FileSelector(folder)):
            stem = info.base_name[:-5]
            if stem.isdigit() and int(stem) < keep:
                store.delete_file(info.path)
