"""Small files in a shared folder that decide which of several writers was first.

A pointer is written under a name of its own and renamed into place; a rename
onto an existing file fails, so exactly one of several writers wins.  The
pointer's text names the folder the winner wrote, and every writer writes to a
folder that no other uses: losing, dying or being slow can't touch what is
published.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.path("").getFileSystem(self._conf)

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}" if name else self.at)

    def names(self, prefix: str = "") -> list[str]:
        if not self._fs.exists(self.path("")):
            return []
        return sorted(n for s in self._fs.listStatus(self.path("")) if (n := s.getPath().getName()).startswith(prefix))

    def exists(self, name: str) -> bool:
        return bool(self._fs.exists(self.path(name)))

    def write(self, name: str, text: str) -> None:
        out = self._fs.create(self.path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        f = self._fs.open(self.path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode()
        finally:
            f.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self.path(name), False)

    def replace(self, name: str, text: str) -> None:
        """A whole new text under a name that may exist; a reader sees the old text or the new one."""
        staged = f"_staged-{uuid.uuid4().hex}"
        self.write(staged, text)
        self._move(staged, name, "OVERWRITE")

    def claim(self, name: str, text: str) -> bool:
        """Puts ``text`` under a name that nobody has taken; False if somebody has."""
        staged = f"_staged-{uuid.uuid4().hex}"
        self.write(staged, text)
        try:
            self._move(staged, name, "NONE")
        except Exception as e:
            self._fs.delete(self.path(staged), False)
            if self.exists(name):
                return False
            raise e
        return self.read(name) == text

    def _move(self, a: str, b: str, how: str) -> None:
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.valueOf(how)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri() if "://" in self.at else self._fs.getUri(), self._conf)
        context.rename(self._fs.makeQualified(self.path(a)), self._fs.makeQualified(self.path(b)), options)


def fresh(kind: str) -> str:
    """A name no other writer uses."""
    return f"{kind}-{uuid.uuid4().hex}"
