"""Durable intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; one is set only where it is missing."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="probewise-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and read it back, so later jobs do not repeat its lineage.

    The files outlive lost executors, unlike blocks kept on them. ``by`` lays them
    out in folders, so that filters on these columns skip the rest.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the Python workers of this session, once."""
    import pathlib
    import zipfile

    import probewise

    sc = spark.sparkContext
    if any("probewise-package" in f for f in sc._python_includes):
        return spark
    root = pathlib.Path(probewise.__file__).parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="probewise-")) / "probewise-package.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, f"probewise/{source.relative_to(root)}")
    sc.addPyFile(str(archive))
    return spark
