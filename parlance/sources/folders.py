"""Folders that driver and executors share, and small files in them that only one writer can create."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="parlance-")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no folder."""
    at, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def read_json(spark: SparkSession, path: str) -> dict:
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def create_json(spark: SparkSession, path: str, value: dict) -> bool:
    """Put a whole file in place unless one is there: of several writers one gets True.

    The text is written beside the place first. A local file takes its name by a hard link, which fails where
    the name is taken; other file systems rename without overwriting.
    """
    at, fs = _at(spark, path)
    own, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(own, True)
    out.write(json.dumps(value).encode())
    out.close()
    jvm, scheme = spark._jvm, fs.getUri().getScheme()
    try:
        if scheme == "file":
            file = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(file(fs.makeQualified(at)), file(fs.makeQualified(own)))
        else:
            how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
            how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(own, at, how)
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(own, False)
