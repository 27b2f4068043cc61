"""Session settings and table access shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "docloom", cores: str | int = "*", **settings: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = SETTINGS | {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": os.environ.get("DOCLOOM_DRIVER_MEMORY", "8g"),
    }
    for key, value in (defaults | settings).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    find_package(spark)
    return spark


def find_package(spark: SparkSession) -> None:
    """Lets Python workers that start in another folder of the same host import this package.

    Clusters ship it in their own way (``--py-files``); a folder that isn't there does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own (tests); a cluster must set it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="docloom-")
    return _own_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/docloom-{label}-{uuid.uuid4().hex}"


#: Rows of a scratch table that Spark may join by broadcast. It goes by the size of files, and a few megabytes of them can hold millions of rows.
MOST_BROADCAST = 100_000


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, which cuts lineage; one of many rows is joined by shuffle."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if out.count() > MOST_BROADCAST:
        out = out.hint("merge")
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` returned and nothing reads any more."""
    for df in tables:
        target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
