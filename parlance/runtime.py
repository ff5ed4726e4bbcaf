"""Session-level helpers shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "parlance", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the operators expect (UTC, adaptive execution, Arrow)."""
    b = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` wins. Only in local mode, where it is unset, a temporary folder is taken:
    a machine-local folder would not survive the loss of an executor on a cluster.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="parlance-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outer_trim(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def plain(c: Column) -> Column:
    """Spelling aside: letter case and outer blanks do not count."""
    return F.lower(outer_trim(c))


def spread(df: DataFrame, rows_a_task: int) -> DataFrame:
    """Rows over a fixed number of tasks, for work that is long beside the size of its rows.

    Adaptive execution would join such small partitions to few tasks. ``df`` should be materialised: it is counted.
    """
    return df.repartition(1 + df.count() // rows_a_task)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table that must be small; more than ``limit`` rows is an error, never a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it is read on the driver and must stay bounded")
    return rows
