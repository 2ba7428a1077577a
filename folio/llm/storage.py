"""The folder that driver and executors share, and files in it by Hadoop's API."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir.

    Only a local session, whose executors are the driver, may go without: it
    gets a temporary folder.  On a cluster one machine's folder is no use to the
    others, so there the setting is required.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="folio-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Files:
    """Hadoop file operations below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        sc = spark.sparkContext
        self.jvm, self.gateway = sc._jvm, sc._gateway
        self.conf = sc._jsc.hadoopConfiguration()
        self.fs = self.jvm.org.apache.hadoop.fs.Path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def sizes(self, folder: str, suffix: str = "") -> dict[str, int]:
        """Bytes of the plain files of a folder by their full path; empty where it is missing."""
        at = self.path(folder)
        if not self.fs.exists(at):
            return {}
        return {str(s.getPath()): s.getLen() for s in self.fs.listStatus(at) if s.isFile() and s.getPath().getName().endswith(suffix)}

    def folders(self, folder: str) -> list[str]:
        """Full paths of the folders in a folder."""
        return sorted(str(s.getPath()) for s in self.fs.listStatus(self.path(folder)) if s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def rename_new(self, source: str, target: str) -> None:
        """Atomic rename that fails when the target exists."""
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        context.rename(self.path(source), self.path(target), self.gateway.new_array(rename, 0))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def saved(df, name: str):
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    return _kept(df, new_path(df.sparkSession, name))


def _kept(df, path: str):
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """One folder for a run's intermediate tables, dropped when the run is over."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, new_path(spark, name)
        self.files = Files(spark, self.root)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.files.delete(self.root)

    def saved(self, df, name: str):
        """As saved, below the run's folder."""
        return _kept(df, f"{self.root}/{name}-{uuid.uuid4().hex}")

    def drop(self, *tables) -> None:
        """Delete tables that were saved here and are not read again."""
        for df in tables:
            for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                self.files.delete(folder)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished stages now, not at some later collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
