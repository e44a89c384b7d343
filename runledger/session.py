"""Session defaults, and the package's way to the executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of a batch that goes to Python: bounds its memory, on either side, where texts are long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}
ROOT = Path(__file__).resolve().parent.parent
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()
_OWN: list[str] = []


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC; recursion deep enough for session trees)."""
    builder = SparkSession.builder.config(map={
        "spark.sql.session.timeZone": "UTC", "spark.sql.cteRecursionLevelLimit": "250",
        "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"} | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, unless PYTHONPATH already does that, and bound the batches that they get."""
    sc = spark.sparkContext
    for key, value in BATCHES.items():  # never over what the caller has set lower; 0 and less are no bound
        if not 0 < _bytes(spark.conf.get(key)) <= int(value):
            spark.conf.set(key, value)
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or sc.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="runledger-")) / "runledger.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in (ROOT / "runledger").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def _bytes(text: str) -> int:
    """A number with or without a unit (k, m, g) as Spark writes it; 0 for what isn't one."""
    found = re.fullmatch(r"(-?\d+)\s*([kmg]?)b?", text.strip().lower())
    return int(found[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[found[2]] if found else 0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, only a session in one process gets an own one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="runledger-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors.

    The write's shuffle files go as soon as the table is there, and the table goes when the driver ends, if `drop` doesn't
    delete it before: whatever hangs on it is to be written by then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
