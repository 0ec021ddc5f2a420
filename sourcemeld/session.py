"""Session defaults and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Generated methods beyond 8000 bytes are never compiled by the JVM; with this limit such stages run by operator, in small methods.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def build_session(master: str | None = None, app: str = "sourcemeld", **conf: str) -> SparkSession:
    """A session with the settings the operators count on; a cluster's own settings win."""
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call sites are looked up per expression otherwise, which dwarfs planning time.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        METHOD_LIMIT: "8000",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (local tests) a temporary folder of this machine is taken.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Intermediate tables written to the shared folder.

    A written table cuts lineage, survives the loss of executors and gives the planner
    exact sizes. Tables live until ``close``; long loops drop the ones they are done with.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{scratch_root(spark)}/sourcemeld-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = {clean: self.spark.conf.get(clean, "false"), METHOD_LIMIT: self.spark.conf.get(METHOD_LIMIT, "65535")}
        self.spark.conf.set(clean, "true")  # the table stands for the shuffles behind it, which may go
        self.spark.conf.set(METHOD_LIMIT, str(min(8000, int(before[METHOD_LIMIT]))))
        try:
            df.write.parquet(path)
        finally:
            for key, value in before.items():
                self.spark.conf.set(key, value)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._scratch_path = path
        return table

    def drop(self, table: DataFrame) -> None:
        path = getattr(table, "_scratch_path", None)
        if path:
            self._delete(path)

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            context = self.spark.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:
            pass  # the session is gone; the shared folder's own clean-up applies
