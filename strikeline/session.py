"""A session with the settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(name: str = "strikeline", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive plans with skew handling, dynamic partition overwrite, and partition values read as text."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
        **settings,
    }
    return builder.config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers that do not start in its folder. Once per session."""
    import shutil
    import tempfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_strikeline_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="spark-")) / "strikeline_package"), "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._strikeline_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share; a local one is made only for local sessions that name none."""
    import tempfile

    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    import uuid

    return f"{scratch_root(spark)}/strikeline/{name}-{uuid.uuid4().hex}"
