"""Tables between steps: written into the folder that driver and executors share.

Lineage is cut by writing a table below ``spark.checkpoint.dir``. A lost executor
costs at most the tasks of the stage that is running, as its inputs are files.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a local one is made only under a ``local`` master."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = context.applicationId
    if app not in _own_dirs:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="assayer-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_dirs[app] = f"file://{folder}"
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/assayer/{uuid.uuid4().hex}/{name}"


def quoted(names: list[str]) -> list[str]:
    """Column names for ``select``, whatever characters they hold."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def materialise(df: DataFrame, name: str, spark: SparkSession | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, by another session where one is given."""
    spark = spark or df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="assayer-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "assayer_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent).as_posix())
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def _path(spark: SparkSession, path: str):
    java = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return java.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), java


def exists(spark: SparkSession, path: str) -> bool:
    fs, java = _path(spark, path)
    return fs.exists(java)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the engine's own; nothing happens where it is not there."""
    fs, java = _path(spark, path)
    fs.delete(java, True)


def mark(spark: SparkSession, path: str) -> None:
    """An empty file, as a sign that a step is done."""
    fs, java = _path(spark, path)
    fs.create(java, True).close()
