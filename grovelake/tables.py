"""Small files and intermediate tables in the folder that all executors share, by Hadoop's file system API."""

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

STALE_S = 600  #: a lock of a lost writer is broken after so many seconds


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, in local mode only, a folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = getattr(spark, "_grovelake_tables", None) or "file://" + tempfile.mkdtemp(prefix="grovelake-")
        spark._grovelake_tables = named
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, it outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Small text files under a path of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Whether the file was made: not if there is one of that name already. Of two writers one wins."""
        path, lock, beside = self._path(name), self._path(f"{name}.lock"), self._path(f"{name}.{uuid.uuid4().hex[:8]}.new")
        if self.fs.exists(path):
            return False
        if self.fs.exists(lock) and time.time() - self.fs.getFileStatus(lock).getModificationTime() / 1000 > STALE_S:
            self.fs.delete(lock, False)  # its writer was lost before the file was there
        self._put(beside, text)
        try:
            return self.fs.createNewFile(lock) and not self.fs.exists(path) and self.fs.rename(beside, path)
        finally:
            self.fs.delete(beside, False)

    def write(self, name: str, text: str) -> None:
        """A file that is written once, by its writer alone."""
        self._put(self._path(name), text)

    def _put(self, path, text: str) -> None:
        stream = self.fs.create(path, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def versions(self, name: str) -> list[int]:
        """The numbers of a numbered file's versions, ascending."""
        head, at = f"{name}.", []
        for found in self.names(name.rpartition("/")[0]):
            found = f"{name.rpartition('/')[0]}/{found}".lstrip("/")
            if found.startswith(head) and found[len(head) :].isdigit():
                at.append(int(found[len(head) :]))
        return sorted(at)

    def read_latest(self, name: str) -> tuple[int, str]:
        """(number, text) of the last version of a numbered file."""
        number = self.versions(name)[-1]
        return number, self.read(f"{name}.{number:012d}")

    def write_next(self, name: str, after: int, text: str, keep: int = 16) -> bool:
        """Whether version ``after + 1`` was made: not if another writer made it. The version before it is never touched."""
        if not self.write_new(f"{name}.{after + 1:012d}", text):
            return False
        for old in self.versions(name)[:-keep]:
            self.delete(f"{name}.{old:012d}")
            self.delete(f"{name}.{old:012d}.lock")
        return True

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder)))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
