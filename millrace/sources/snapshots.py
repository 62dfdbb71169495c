"""Whole copies of a table, published by one step: data in a folder of its own, then a manifest that names it.

A reader takes the manifest of the highest version. It is put in place under a name that must not exist yet, so a crash leaves
the old copy or the new one, and of two writers that read the same version one gets a Conflict.
"""

from __future__ import annotations

import json
import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from .landing import StaleSnapshot

DATA, MANIFESTS = "data", "manifests"


class Conflict(RuntimeError):
    """Another writer has published the version that this one was going to."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _read(spark: SparkSession, path: str) -> dict:
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _put_new(spark: SparkSession, path: str, text: str) -> None:
    """A file with this text, whole or not at all; if there is one by this name already, a Conflict."""
    fs, where = _fs(spark, path)
    _, draft = _fs(spark, f"{path}.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(draft.toUri().getPath(), where.toUri().getPath())  # the local store's rename would overwrite
            return
        kind = spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = spark._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, where, options)
    except Exception as e:
        if fs.exists(where):
            raise Conflict(f"{path} has been published already") from e
        raise
    finally:
        fs.delete(draft, False)


def versions(spark: SparkSession, base: str) -> list[int]:
    fs, where = _fs(spark, f"{base}/{MANIFESTS}")
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, base: str, version: int | None = None) -> dict | None:
    """version, path, rows, taken_at, schema of a version, or of the last one; None if there is none."""
    known = versions(spark, base)
    if not known:
        return None
    return _read(spark, f"{base}/{MANIFESTS}/{known[-1] if version is None else version:010d}.json")


def read_snapshot(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    found = manifest(spark, base, version)
    if found is None:
        raise FileNotFoundError(f"no copy has been published in {base}")
    return spark.read.schema(found["schema"]).parquet(f"{base}/{DATA}/{found['path']}")


def publish(df: DataFrame, base: str, taken_at: str, least_share: float = 0.5, expected: int | None = None) -> int:
    """Write df as the next version and return its number.

    expected: the version that the copy was made from (0: none), so that nothing that came in since is lost; without it, the
    last one as the writing begins. A copy that is older than the last one or far smaller is a StaleSnapshot.
    """
    spark = df.sparkSession
    last = manifest(spark, base)
    at = (last["version"] if last else 0) if expected is None else expected
    if (last["version"] if last else 0) != at:
        raise Conflict(f"{base} is at version {last['version'] if last else 0}, not {at}")
    folder = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{DATA}/{folder}")
    schema = df.schema.toDDL() if hasattr(df.schema, "toDDL") else df._jdf.schema().toDDL()
    rows = spark.read.schema(schema).parquet(f"{base}/{DATA}/{folder}").count()
    if last and last["taken_at"] > taken_at:
        raise StaleSnapshot(f"{base} is of {last['taken_at']}")
    if last and rows < least_share * last["rows"]:
        raise StaleSnapshot(f"the new copy of {base} has lost too many rows")
    fs, where = _fs(spark, f"{base}/{MANIFESTS}")
    fs.mkdirs(where)
    new = {"version": at + 1, "path": folder, "rows": rows, "taken_at": taken_at, "schema": schema}
    _put_new(spark, f"{base}/{MANIFESTS}/{at + 1:010d}.json", json.dumps(new))
    return at + 1


def collect_orphans(spark: SparkSession, base: str, keep: int = 2, older_than_seconds: float = 86_400.0) -> list[str]:
    """Delete data that no one of the last `keep` manifests names and that is older than any writer or reader may take, and older manifests. Returns the folders."""
    known = versions(spark, base)
    named = {_read(spark, f"{base}/{MANIFESTS}/{v:010d}.json")["path"] for v in known[-keep:]}
    fs, where = _fs(spark, f"{base}/{DATA}")
    limit, gone = (time.time() - older_than_seconds) * 1000, []
    for v in known[:-keep]:
        fs.delete(_fs(spark, f"{base}/{MANIFESTS}/{v:010d}.json")[1], False)
    for entry in fs.listStatus(where) if fs.exists(where) else []:
        name = entry.getPath().getName()
        if name not in named and int(name.split("-")[0]) <= limit:
            fs.delete(entry.getPath(), True)
            gone.append(name)
    return sorted(gone)
