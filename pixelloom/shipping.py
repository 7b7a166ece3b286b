"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Where it is unset, a fresh one if everything runs in this process (tests), which is then the checkpoint folder; an error on a cluster, whose machines would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="pixelloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _zipped() -> bytes:
    root, out = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Writes the package's sources to the shared folder, once an application, and has workers import them from there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{uuid.uuid4().hex}/pixelloom.zip")
    stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    try:
        stream.write(bytearray(_zipped()))
    finally:
        stream.close()
    sc.addPyFile(path.toString())
    _SHIPPED.add(sc.applicationId)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df, written to a path of its own in the shared folder and read again: what is used more than once is computed once, and a lost executor costs no stage before it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
