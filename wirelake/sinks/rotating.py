"""Round trips as JSON lines in files that rotate, as a Spark data source for batches and streams.

``df.write.format("roundtrips").option("path", ...)`` and ``df.writeStream.format("roundtrips")``. A task writes to files of its own beside the target and hands their names on; only
when all tasks are done does the driver move those it was told of to their names, and take away the rest. So an attempt that fails, or runs twice, leaves nothing. Of a stream each
micro-batch leaves a list of its files; one that runs again after its files are there is passed over.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STAGING, COMMITS = "_staging", "_commits"


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, in order, with the number of lines and bytes of each."""

    part: int
    files: list[tuple[str, int, int]]


def _plain(value):  # noqa: ANN001, ANN202
    """What JSON can say; bytes as text as far as they are."""
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items() if v is not None}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


class _Files:
    """The shared work of both writers. ``max_bytes`` is the size from which a file is closed and the next begun; ``max_files`` how many files stay, the newest (0: all)."""

    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.max_bytes, self.max_files = int(options.get("max_bytes") or 100 << 20), int(options.get("max_files") or 0)
        self.run = uuid.uuid4().hex[:12]

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri}")

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = self._at()
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        folder = f"{root}/{STAGING}/{self.run}"
        store.create_dir(folder, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, name, lines, size = None, "", 0, 0
        for row in rows:
            if out is None:
                name, lines, size = f"{folder}/{part:05d}-{uuid.uuid4().hex}", 0, 0
                out = store.open_output_stream(name)
            line = (json.dumps(_plain(row), ensure_ascii=False) + "\n").encode()
            out.write(line)
            lines, size = lines + 1, size + len(line)
            if size >= self.max_bytes:
                out.close()
                done.append((name, lines, size))
                out = None
        if out is not None:
            out.close()
            done.append((name, lines, size))
        return Written(part, done)

    def publish(self, messages: list[Written | None], stamp: str) -> list[str]:
        """Moves the files that were told of to names that go up with time, and removes the oldest beyond ``max_files``."""
        store, root = self._at()
        names = []
        told = sorted((x for x in messages if x is not None), key=lambda x: x.part)
        for k, (name, _, _) in enumerate(f for m in told for f in m.files):
            names.append(f"{root}/roundtrips-{stamp}-{k:06d}.jsonl")
            store.move(name, names[-1])
        self.forget()
        if self.max_files:
            found = [x.path for x in store.get_file_info(fs.FileSelector(root)) if x.type == fs.FileType.File and x.base_name.startswith("roundtrips-")]
            for old in sorted(found)[: -self.max_files]:
                store.delete_file(old)
        return names

    def forget(self) -> None:
        """Removes what attempts of this run have left."""
        store, root = self._at()
        if store.get_file_info(f"{root}/{STAGING}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{STAGING}/{self.run}")


class BatchWriter(_Files, DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        super().__init__(options)
        self.overwrite = overwrite

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._at()
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if x.type == fs.FileType.File and x.base_name.startswith("roundtrips-"):
                    store.delete_file(x.path)
        self.publish(messages, f"{time.time_ns():020d}")

    def abort(self, messages: list[Written | None]) -> None:
        self.forget()


class StreamWriter(_Files, DataSourceStreamWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        store, root = self._at()
        mark = f"{root}/{COMMITS}/{batchId:012d}"
        if store.get_file_info(mark).type == fs.FileType.File:
            self.forget()
            return
        # What an earlier try to commit this batch has moved before it broke off goes first.
        stamp = f"{batchId:020d}"
        for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith(f"roundtrips-{stamp}-"):
                store.delete_file(x.path)
        names = self.publish(messages, stamp)
        store.create_dir(f"{root}/{COMMITS}", recursive=True)
        with store.open_output_stream(mark) as out:
            out.write("\n".join(names).encode())

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.forget()


class RoundTripSink(DataSource):
    """Registered as ``roundtrips``; options ``path``, ``max_bytes`` and ``max_files``. Null fields are left out of lines."""

    @classmethod
    def name(cls) -> str:
        return "roundtrips"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BatchWriter(dict(self.options), overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return StreamWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RoundTripSink)
