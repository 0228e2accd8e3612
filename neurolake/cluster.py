"""Putting this package on the executors, and the folder that they share with the driver."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Add this package to the application's Python files, once a session, so that workers anywhere can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_neurolake_shipped", False):
        return
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="neurolake-")
    archive = os.path.join(folder, "neurolake_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(archive)
    sc._neurolake_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. On one machine, where the session names none, a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="neurolake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed and kept in the shared folder: it is used several times, and lost executors cost their tasks only."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, in any order: for tables that are made of one another in rounds.

    A checkpoint goes on with its plan's estimated size, and a join's estimate is the product of its sides': it would be squared each round, to numbers
    that fill the driver's memory. A file's size is what it is.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
