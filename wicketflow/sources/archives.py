"""ZIP archives as a data source: members are dealt to tasks from the archives' central directories, so that one archive is read by several."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "zip_members"
#: Bytes of members, as they lie in the archive, that a task reads; a larger member is a task of its own.
TASK_BYTES = 32 << 20


def _source():
    """The data source's class, made in a function so that it travels to the executors by value."""
    from pyarrow import fs
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Opened(io.BufferedIOBase):
        """A file of any store, whose wrong seeks fail as zipfile expects it: tiny archives begin with one."""

        def __init__(self, path: str) -> None:
            store, inside = fs.FileSystem.from_uri(path)
            self.file = store.open_input_file(inside)

        def seekable(self) -> bool:
            return True

        def readable(self) -> bool:
            return True

        def seek(self, offset: int, whence: int = 0) -> int:
            at = offset + (0, self.file.tell(), self.file.size())[whence]
            if at < 0:
                raise OSError("before the file's beginning")
            return self.file.seek(at)

        def tell(self) -> int:
            return self.file.tell()

        def read(self, size: int = -1) -> bytes:
            return self.file.read(None if size is None or size < 0 else size)

        def close(self) -> None:
            self.file.close()
            super().close()

    class Members(InputPartition):
        def __init__(self, path: str, names: list[str]) -> None:
            self.path, self.names = path, names

    class Reader(DataSourceReader):
        def __init__(self, options) -> None:
            self.path, self.ending = options["path"], options.get("ending", "")
            self.most = int(options.get("taskBytes", TASK_BYTES))

        def partitions(self) -> list[Members]:
            store, inside = fs.FileSystem.from_uri(self.path)
            at = store.get_file_info(inside)
            files = [at] if at.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside, recursive=True))
            scheme = self.path.partition("://")[0] + "://" if "://" in self.path else ""
            out = []
            for file in sorted((f for f in files if f.type == fs.FileType.File and f.path.endswith(".zip")), key=lambda f: f.path):
                path = scheme + file.path
                with Opened(path) as raw, zipfile.ZipFile(raw) as z:  # reads the directory at the archive's end only
                    held, size = [], 0
                    for info in z.infolist():
                        if info.is_dir() or not info.filename.endswith(self.ending):
                            continue
                        if held and size + info.compress_size > self.most:
                            out.append(Members(path, held))
                            held, size = [], 0
                        held.append(info.filename)
                        size += info.compress_size
                    if held:
                        out.append(Members(path, held))
            return out

        def read(self, part: Members) -> Iterator[tuple[str, str, bytes]]:
            with Opened(part.path) as raw, zipfile.ZipFile(raw) as z:
                for name in part.names:
                    yield part.path, name, z.read(name)

    class Zip(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self) -> str:
            return "archive string, member string, content binary"

        def reader(self, schema) -> Reader:
            return Reader(self.options)

    return Zip


def read_members(spark: SparkSession, path: str, *, ending: str = "", task_bytes: int = TASK_BYTES) -> DataFrame:
    """(archive, member, content) of the ZIP archives at or under path, of members whose names end so.

    A task holds one member at a time. path is of a store that pyarrow knows (local, file, s3, gs, hdfs); the driver reads the
    archives' directories, the tasks their members. A member that is named twice in an archive is read as often, in its last
    form. A broken archive raises.
    """
    spark.dataSource.register(_source())
    return spark.read.format(FORMAT).option("ending", ending).option("taskBytes", str(task_bytes)).load(path)


def write_archives(rows: DataFrame, name: str, content: str, path: str) -> DataFrame:
    """rows' content (string or binary) as ZIP archives under path, one for each of rows' partitions; (archive, members) of each.

    An archive is written under another name first and then moved, so a task that runs again leaves no half of one.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        target, n = f"{folder}/{uuid.uuid4().hex}", 0
        with store.open_output_stream(f"{target}.part") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for batch in (first, *batches):
                for member, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    z.writestr(member, body)
                    n += 1
        store.move(f"{target}.part", f"{target}.zip")
        yield pa.RecordBatch.from_arrays([pa.array([f"{target}.zip"]), pa.array([n], pa.int64())], names=["archive", "members"])

    return rows.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInArrow(pack, "archive string, members long")
