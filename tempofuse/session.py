"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable on executors that do not have the repository on their PYTHONPATH."""
    app = spark.sparkContext.applicationId
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _shipped or str(ROOT) in on_path:
        return
    to = Path(tempfile.mkdtemp(prefix="tempofuse-")) / "tempofuse_src.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in [*ROOT.glob("tempofuse/**/*.py"), *ROOT.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a local session may have none; it
    gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        at = spark.sparkContext.getCheckpointDir()
        base = at.rsplit("/", 1)[0] if at else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tempofuse-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: what is used more than once is made once, and a lost executor
    costs none of it."""
    path = f"{shared_dir(df.sparkSession)}/tempofuse-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
