"""Session settings and the shared scratch folder that cuts lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, so that they need no path of their own to it."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    here = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="tessera-code-"), "tessera-code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(target))
    sc._tessera_shipped = True


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where the cluster names none (tests on one machine) an own folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(own)
    return jsc.getCheckpointDir().get().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone; the folder belongs to the cluster then
        pass


class Scratch:
    """Written tables of one run in the shared folder; a lost executor re-reads them instead of recomputing."""

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(_delete, spark, self.root)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """The written table and its number of rows, which is observed while it is written."""
        seen = Observation()
        out = self.cut(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return out, seen.get["n"]

    def several(self, names: list[str], schema) -> DataFrame:
        """Tables of one schema that were written before, as one scan."""
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{n}" for n in names))

    def drop(self, name: str) -> None:
        """For a table that no later plan reads."""
        _delete(self.spark, f"{self.root}/{name}")


def is_blank(c: Column | str) -> Column:
    """True for null and for text without a non-blank character."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | ~c.rlike(r"(?U)\S")


def one_per_id(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per id: that of the smallest commit hash (rows of an id are meant to agree otherwise)."""
    if "commit_hash" not in df.columns:
        return df.dropDuplicates([key])
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last("commit_hash"))
    return df.withColumn("__i", F.row_number().over(order)).filter("__i = 1").drop("__i")


def build_session(app: str = "tessera", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings that the operators assume; on a cluster give only what the cluster doesn't set."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    spark = b.config(map=conf).getOrCreate()
    ship(spark)
    return spark
