"""Small documents at any path that Spark reaches: local files, and URIs through its Hadoop file systems."""

from __future__ import annotations

import posixpath
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def is_uri(path: str | Path) -> bool:
    """Whether a path has a scheme, ``file`` included."""
    return isinstance(path, str) and len(urlparse(path).scheme) > 1


def beside(base: str | Path, path: str) -> str | Path:
    """A path relative to a folder; URIs and absolute paths are what they are (absolute ones on the folder's store)."""
    if is_uri(path):
        return path
    if is_uri(base):
        at = urlparse(str(base))
        return at._replace(path=posixpath.normpath(posixpath.join(at.path, path))).geturl()
    p = Path(path)
    return p if p.is_absolute() else (Path(base) / p).resolve()


def given(path: str) -> str | Path:
    """A path as a user gives it: URIs stay, others are local and become absolute."""
    return path if is_uri(path) else Path(path).expanduser().resolve()


def folder_of(path: str | Path) -> str | Path:
    return path.rsplit("/", 1)[0] if isinstance(path, str) else path.parent


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def read_text(path: str | Path, spark: SparkSession | None = None) -> str:
    """A document's text; URIs need a session."""
    if not is_uri(path):
        return Path(path).read_text(encoding="utf-8")
    if spark is None:
        raise ValueError(f"Reading {path} needs a Spark session")
    fs, place = _place(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str | Path, text: str) -> None:
    """Write a document whole, replacing what is there; folders above it are made."""
    if not is_uri(path):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
        return
    fs, place = _place(spark, path)
    stream = fs.create(place, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
