"""The folder that the driver and all executors share, and intermediate tables in it."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """From spark.checkpoint.dir; where that is unset, a temporary one, which only a session of one machine may have."""
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir"):
        return found
    if not conf.get("spark.master", "").startswith("local") or conf.get("spark.master").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and a lost executor costs no more than reading it again."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    if path := getattr(df, "_written_at", None):
        remove(df.sparkSession, path)


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme, which on the driver may be left to the default file system."""
    fs, at = _fs(spark, path)
    out = fs.makeQualified(at).toString()
    return out.replace("file:/", "file:///", 1) if out.startswith("file:/") and not out.startswith("file:///") else out


def names_in(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def commit_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write under a temporary name, then give it the final one in a step that never replaces a file; False if path is there already.

    On a local disk that step is a hard link, elsewhere a rename that refuses an existing target, which must be atomic
    in the file system (as in HDFS).
    """
    fs, at = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(tmp, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    done = _linked(tmp, at) if fs.getScheme() == "file" else _renamed(spark, tmp, at)
    fs.delete(tmp, False)
    return done


def _linked(tmp, at) -> bool:
    try:
        os.link(tmp.toUri().getPath(), at.toUri().getPath())
    except FileExistsError:
        return False
    return True


def _renamed(spark: SparkSession, tmp, at) -> bool:
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(tmp, at, options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
            return False
        raise
    return True


def age(spark: SparkSession, path: str) -> float:
    """Seconds since a file or folder was last changed."""
    fs, at = _fs(spark, path)
    return time.time() - fs.getFileStatus(at).getModificationTime() / 1000
