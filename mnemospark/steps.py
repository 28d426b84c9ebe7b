"""Tables that iterative plans write between their steps, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, as in tests, a temporary one, in local mode only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="steps-")
    return _own[app]


class Steps:
    """Writes a frame and reads it again, so that a lost executor costs a reread; the tables go when the process ends or by done()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark).rstrip('/')}/steps-{uuid.uuid4().hex}", 0
        atexit.register(self.done)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.root}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{self.n}")

    def done(self) -> None:
        """Only once nothing reads the tables any more."""
        try:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001  the session may have ended; nothing depends on the deletion
            pass
