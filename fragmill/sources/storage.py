"""Storage backends: put, get, delete, exists, ping over any file system that pyarrow opens by its URI.

Workers open backends themselves, so bytes never pass the driver.  A put writes beside its target and renames, so a
reader sees all of a file or none of it; a task that is run again writes the same names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tries of a write.
TRIES = 3
_FACTORIES: dict = {}


class Backend:
    """A folder of a file system: file://, s3://, hdfs:// or a plain path."""

    def __init__(self, uri: str):
        self.fs, self.root = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)

    def _at(self, name: str) -> str:
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"{name!r} leaves the backend's folder")
        return f"{self.root.rstrip('/')}/{name}"

    def put(self, name: str, data: bytes) -> None:
        target, beside = self._at(name), self._at(f"{name}.{uuid.uuid4().hex}.part")
        self.fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
        try:
            with self.fs.open_output_stream(beside) as f:
                f.write(data)
            self.fs.move(beside, target)
        except BaseException:
            if self.fs.get_file_info(beside).type != fs.FileType.NotFound:
                self.fs.delete_file(beside)
            raise

    def get(self, name: str) -> bytes:
        with self.fs.open_input_stream(self._at(name)) as f:
            return f.read()

    def delete(self, name: str) -> None:
        self.fs.delete_file(self._at(name))

    def exists(self, name: str) -> bool:
        return self.fs.get_file_info(self._at(name)).type == fs.FileType.File

    def received(self, name: str) -> int:
        """Bytes of an upload in parts that have arrived, from which it goes on."""
        info = self.fs.get_file_info(self._at(f"{name}.part"))
        return info.size if info.type == fs.FileType.File else 0

    def resume(self, name: str, offset: int, data: bytes, last: bool = False) -> int:
        """Takes the bytes from `offset` on, which has to be where the upload stands; the last part makes it a file."""
        if offset != self.received(name):
            raise ValueError(f"{name} stands at {self.received(name)}, not {offset}")
        part = self._at(f"{name}.part")
        self.fs.create_dir(part.rsplit("/", 1)[0], recursive=True)
        before = self.get(f"{name}.part") if offset else b""
        with self.fs.open_output_stream(part) as f:
            f.write(before + data)
        if last:
            self.fs.move(part, self._at(name))
        return offset + len(data)

    def cleaned(self, hours: float, now: datetime | None = None) -> list[str]:
        """Deletes parts that nobody has added to for so long; their names."""
        end = (now or datetime.now(timezone.utc)) - timedelta(hours=hours)
        found = self.fs.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        old = [i.path for i in found if i.type == fs.FileType.File and i.path.endswith(".part") and i.mtime < end]
        for path in old:
            self.fs.delete_file(path)
        return sorted(path[len(self.root.rstrip("/")) + 1 :] for path in old)

    def names(self) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(self.root, recursive=True, allow_not_found=True))
        return sorted(i.path[len(self.root.rstrip("/")) + 1 :] for i in found if i.type == fs.FileType.File and not i.path.endswith(".part"))

    def ping(self) -> bool:
        try:
            self.fs.get_file_info(self.root)
            return True
        except OSError:
            return False


def register(kind: str, factory: Callable[[str], Backend]) -> None:
    """A kind of backend, whatever its case; on a cluster the factory has to be importable by workers."""
    _FACTORIES[kind.lower()] = factory


def opened(kind: str, uri: str) -> Backend:
    return _FACTORIES.get(kind.lower(), Backend)(uri)


register("path", Backend)


def stored(files: DataFrame) -> DataFrame:
    """Writes files (kind, uri, name, data): name, bytes, error (null if written), one row each.

    A write is tried up to `TRIES` times; what fails for good is told, not raised, so that the rest is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for kind, uri, name, data in zip(*(b.column(i).to_pylist() for i in range(4))):
                error = None
                for _ in range(TRIES):
                    try:
                        opened(kind, uri).put(name, data)
                        error = None
                        break
                    except (OSError, ValueError) as e:
                        error = str(e)
                out.append((name, len(data), error))
            names, sizes, errors = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], names=["name", "bytes", "error"])

    return files.select("kind", "uri", "name", F.coalesce("data", F.lit(b"")).alias("data")).mapInArrow(run, "name string, bytes long, error string")


def rolled_back(files: DataFrame) -> int:
    """Deletes files (kind, uri, name) that are there, as after a write that was given up; how many went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = 0
            for kind, uri, name in zip(*(b.column(i).to_pylist() for i in range(3))):
                x = opened(kind, uri)
                if x.exists(name):
                    x.delete(name)
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("kind", "uri", "name").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def fetched(locations: DataFrame, backends: DataFrame) -> DataFrame:
    """locations (backend, name, ...) with `data` from their backend (name, kind, uri), null and `error` where it fails.

    A backend that no row of `backends` names is an error of its rows too.
    """
    b = backends.select(F.col("name").alias("_backend"), F.col("kind").alias("_kind"), F.col("uri").alias("_uri"))
    joined = locations.join(b, F.lower(locations["backend"]) == F.lower("_backend"), "left").drop("_backend")
    schema = locations.schema.add("data", "binary").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, errors = [], []
            for name, kind, uri in zip(*(batch.column(c).to_pylist() for c in ("name", "_kind", "_uri"))):
                try:
                    if uri is None:
                        raise OSError("unknown backend")
                    data.append(opened(kind, uri).get(name))
                    errors.append(None)
                except (OSError, ValueError) as e:
                    data.append(None)
                    errors.append(str(e))
            kept = batch.drop_columns(["_kind", "_uri"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(data, pa.binary()), pa.array(errors, pa.string())], names=[*kept.schema.names, "data", "error"])

    return joined.mapInArrow(run, schema)


def objects_read(locations: DataFrame, backends: DataFrame) -> DataFrame:
    """object_id, fragments, failed, content: pieces in order of frag_idx; null content if any failed.

    Failures are counted, not raised; an object with no piece left has failed = fragments.
    """
    from ..operators.recovery import merged

    f = fetched(locations, backends)
    out = f.groupBy("object_id").agg(F.count(F.lit(1)).alias("fragments"), F.count_if(F.col("error").isNotNull()).alias("failed"), merged("frag_idx", "data").alias("_c"))
    return out.select("object_id", "fragments", "failed", F.when(F.col("failed") == 0, F.col("_c")).alias("content"))


def transfer_plan(expected: DataFrame, present: DataFrame, keep_source: bool = False) -> DataFrame:
    """expected (object_id, part, name) with step and action: copy, move or skip.

    part is fragment, index or rc.  What the source lacks is skipped.  Fragments go first (step 0), then the index (1) and
    the recovery container (2), so that an index never stands beside fragments that have not arrived; the container stays
    at the source too.
    """
    there = present.select("name", F.lit(True).alias("_there")).distinct()
    step = F.when(F.col("part") == "fragment", 0).when(F.col("part") == "index", 1).otherwise(2)
    taken = F.when(F.lit(keep_source) | (F.col("part") == "rc"), "copy").otherwise("move")
    return expected.join(there, "name", "left").withColumn("step", step).withColumn("action", F.when(F.col("_there"), taken).otherwise("skip")).drop("_there")


def transferred(plan: DataFrame, source: str, target: str) -> DataFrame:
    """Carries a plan out, step by step: name, bytes, error of what was copied or moved.  Later steps wait for errors."""
    done = None
    for step in (0, 1, 2):
        rows = plan.where((F.col("step") == step) & (F.col("action") != "skip")).select("name", "action")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b = opened("path", source), opened("path", target)
            for batch in batches:
                out = []
                for name, action in zip(*(batch.column(i).to_pylist() for i in range(2))):
                    try:
                        if a.exists(name) or not b.exists(name):  # a task that is run again finds its files moved
                            data = a.get(name)
                            b.put(name, data)
                            if action == "move":
                                a.delete(name)
                        else:
                            data = b.get(name)
                        out.append((name, len(data), None))
                    except OSError as e:
                        out.append((name, 0, str(e)))
                cols = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string()))], names=["name", "bytes", "error"])

        spark = plan.sparkSession
        got = spark.createDataFrame(rows.mapInArrow(run, "name string, bytes long, error string").collect(), "name string, bytes long, error string")  # names of one object's files
        done = got if done is None else done.unionByName(got)
        if not got.where("error is not null").isEmpty():
            break
    return done
