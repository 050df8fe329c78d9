"""Folders that readers see whole or not at all.

A writer fills a new folder of its own and then publishes it by one atomic step, the rename of a
small file to ``<base>/_commits/<run>/<number>-<id>`` that names the folder. Readers list the
commits and read, for every run, the folder of its last one; what a killed writer left has no commit
and is never read. Writing a run again publishes its new folder in the place of the old one, so
a rerun neither doubles rows nor shows half of them. The version before the last stays for
readers that have just listed it, older ones and the remains of killed writers are deleted.

All file operations go through Spark's file systems, so the folder may be in any store it writes.
The commit needs a file system whose rename is atomic.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote, unquote

from pyspark.sql import SparkSession

COMMITS = "_commits"


class _Files:
    def __init__(self, spark: SparkSession, base: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(base).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def publish(self, target: str, content: str) -> None:
        """``target`` appears with all its content, or not at all."""
        folder, name = target.rsplit("/", 1)
        temp = self.path(f"{folder}/.{name}")
        self.fs.mkdirs(self.path(folder))
        out = self.fs.create(temp, True)
        out.write(bytearray(content.encode()))
        out.close()
        if not self.fs.rename(temp, self.path(target)):
            raise OSError(f"could not publish {target}")

    def content(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def _versions(files: _Files, base: str, run: str) -> list[str]:
    return [n for n in files.names(f"{base}/{COMMITS}/{run}") if not n.startswith(".")]


def write_committed(spark: SparkSession, base: str, run: str, write: Callable[[str], None],
                    replace: bool = True) -> str:
    """Have ``write(folder)`` fill a new folder and publish it as ``run``; the folder's path. With
    ``replace=False`` a run that is published already is left as it is and nothing is written."""
    base, name = base.rstrip("/"), quote(run, safe="")
    files = _Files(spark, base)
    before = _versions(files, base, name)
    if before and not replace:
        return f"{base}/{files.content(f'{base}/{COMMITS}/{name}/{before[-1]}')}"
    token = uuid.uuid4().hex
    folder = f"{name}-{token}"
    write(f"{base}/{folder}")
    number = int(before[-1].split("-")[0]) + 1 if before else 0
    files.publish(f"{base}/{COMMITS}/{name}/{number:012d}-{token}", folder)
    _clean(files, base, name)
    return f"{base}/{folder}"


def _clean(files: _Files, base: str, name: str) -> None:
    versions = _versions(files, base, name)
    keep = {files.content(f"{base}/{COMMITS}/{name}/{v}") for v in versions[-2:]}
    for v in versions[:-2]:
        files.delete(f"{base}/{COMMITS}/{name}/{v}")
    for folder in files.names(base):
        if folder.startswith(f"{name}-") and len(folder) == len(name) + 33 and folder not in keep:
            files.delete(f"{base}/{folder}")


def committed(spark: SparkSession, base: str) -> dict[str, str]:
    """{run: path of its published folder}, in the order of their names."""
    base = base.rstrip("/")
    files = _Files(spark, base)
    out = {}
    for name in files.names(f"{base}/{COMMITS}"):
        versions = _versions(files, base, name)
        if versions:
            out[unquote(name)] = f"{base}/{files.content(f'{base}/{COMMITS}/{name}/{versions[-1]}')}"
    return out


def committed_paths(spark: SparkSession, base: str) -> list[str]:
    """Paths of all published folders; an error where there is none."""
    paths = list(committed(spark, base).values())
    if not paths:
        raise FileNotFoundError(f"nothing is published in {base}")
    return paths
