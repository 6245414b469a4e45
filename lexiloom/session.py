"""Session construction and the shared working folder."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexiloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below ``spark.checkpoint.dir`` that all executors see.

    Only a local master may fall back to a machine-local folder; on a cluster
    a missing setting is an error, because another machine would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="lexiloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df):
    """Reliable ``checkpoint()``; sets a checkpoint folder only where none is set."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoint"))
    return df.checkpoint()


def side_by_side(steps: Sequence[Callable[[], object]]) -> list:
    """What steps that do not need each other return, in their order; each submits its jobs from a thread of its own."""
    with ThreadPoolExecutor(max(1, len(steps))) as threads:
        # Each with properties of its own, which name the query that a job belongs to.
        started = [threads.submit(inheritable_thread_target(SparkSession.active())(step)) for step in steps]
        return [x.result() for x in started]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per session.

    Needed only where it is not installed on the workers, e.g. a source checkout.
    """
    context = spark.sparkContext
    if getattr(context, "_lexiloom_shipped", False):
        return
    here = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="lexiloom-")) / "lexiloom.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(here.rglob("*.py")):
            archive.write(source, f"{here.name}/{source.relative_to(here)}")
    context.addPyFile(str(target))
    context._lexiloom_shipped = True
