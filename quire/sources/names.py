"""Names that exactly one of several writers gets: a file that is created only if it is absent, in the folder all share."""

from __future__ import annotations

import os
import time
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class Names:
    """Taken names below a folder. HDFS-like file systems create a file once; on a local one the operating system does."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def take(self, name: str, stale: float = 90.0) -> bool:
        """Whether this call took the name. Of any number of writers at once one gets True. A name that was taken longer ago,
        by a writer that seems to have died before it acted, can be taken once more."""
        attempt = 0
        while True:
            one = f"{name}.{attempt}"
            if self._create(one):
                return True
            if self._age(one) < stale:
                return False
            attempt += 1

    def _age(self, name: str) -> float:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return time.time() - path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime() / 1000

    def _create(self, name: str) -> bool:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(conf)
        fs.mkdirs(path.getParent())
        if fs.getUri().getScheme() == "file":
            try:
                os.close(os.open(unquote(urlparse(fs.makeQualified(path).toString()).path), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                return True
            except FileExistsError:
                return False
        try:
            fs.create(path, False).close()
            return True
        except Exception:
            if fs.exists(path):
                return False
            raise
