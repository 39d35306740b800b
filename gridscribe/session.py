"""What a session needs: this package on its executors, and durable cuts of lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, unless PYTHONPATH already has it for them."""
    here = str(_ROOT.parent)
    context = spark.sparkContext
    if here in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_gridscribe_shipped", False):
        return
    bundle = Path(tempfile.mkdtemp(prefix="gridscribe-code-")) / "gridscribe-code.zip"
    with zipfile.ZipFile(bundle, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(_ROOT.rglob("*.py")):
            z.write(path, path.relative_to(_ROOT.parent))
    context.addPyFile(str(bundle))
    context._gridscribe_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; only in local mode, as in tests, a folder of our own where it names none."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not context.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="gridscribe-checkpoint-")
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder: much smaller than a checkpoint, for many rows of numbers."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._stored_at = path
    return made


def forget(*tables: DataFrame) -> None:
    """Delete tables that `stored` made, once everything that was derived from them is stored, too."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path is not None:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
