"""Files by path or URI."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def opened(path: str):
    """pyarrow's random-access file."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, at = fs.FileSystem.from_uri(path)
    else:
        system, at = fs.LocalFileSystem(), path
    return system.open_input_file(at)


def local(path: str) -> str:
    """The POSIX path of a local path or file URI; logs are written in place there."""
    for start in ("file://", "file:"):
        if path.startswith(start):
            return "/" + path[len(start) :].lstrip("/")
    if "://" in path:
        raise ValueError(f"a log is appended in place, which {path} doesn't allow; write to a POSIX path")
    return path


def scratch(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share, removed when this Python ends: below spark.checkpoint.dir, or a temporary one under a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        folder = f"{local(shared.rstrip('/'))}/tidelog/log-{uuid.uuid4().hex}"
        os.makedirs(folder)
        atexit.register(shutil.rmtree, folder, True)
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tidelog-")
    atexit.register(shutil.rmtree, folder, True)
    return folder
