"""Folders for tables that a query writes and reads again, seen by the driver and all executors, and small
files in them that are made once."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Folders of local sessions that name none, by application.
_own: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """The URI of a folder of its own below ``spark.checkpoint.dir``, not made yet.

    A temporary folder stands in only where none is set and Spark runs locally.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is no such file."""
    jvm, place, store = _file_system(spark, path)
    if not store.exists(place):
        return None
    stream = store.open(place)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file unless it is there already, whole or not at all; whether this call made it.

    It is written under a name of its own and moved without replacing, which the file system decides:
    of several writers one succeeds. Local files are linked, since there a rename replaces.
    """
    jvm, place, store = _file_system(spark, path)
    draft = place.getParent().suffix(f"/.{place.getName()}-{uuid.uuid4().hex}")
    out = store.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if store.getUri().getScheme() == "file":
        try:
            os.link(draft.toUri().getPath(), place.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            store.delete(draft, False)
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(options, 1)
    how[0] = options.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(store.makeQualified(draft), store.makeQualified(place), how)
        return True
    except Py4JJavaError as e:
        store.delete(draft, False)
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
