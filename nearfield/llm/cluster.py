"""What every operator here needs from the cluster: code on the workers, durable cuts in a plan."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, whatever their path is; once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(), "nearfield_src.zip")
    with zipfile.ZipFile(target, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, named by spark.checkpoint.dir; where none is set a temporary one, if all is one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints"))
    return context.getCheckpointDir()


def durable(frame: DataFrame) -> DataFrame:
    """Cuts the plan of a small frame by a checkpoint in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame) -> DataFrame:
    """Cuts the plan of a large frame by a Parquet table in the shared folder, which goes when the application ends."""
    spark = frame.sparkSession
    name = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(name)
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.parquet(name)
