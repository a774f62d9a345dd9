"""Written intermediate tables in the folder that all executors share.

Iterative plans cut their lineage here. A written table survives the loss of any executor, is column-pruned when it is
read again, and its size is known, unlike a cached or locally checkpointed one.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only where it is unset, as in tests, a temporary folder takes its place."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="skeinlake-")
        atexit.register(shutil.rmtree, _own[app], True)
    return "file://" + _own[app]


class Stage:
    """Tables of one run. ``cut`` writes a plan and returns a scan of it; ``drop`` removes what no later plan reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.paths: dict[int, str] = {}
        self.count = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._stage_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = getattr(df, "_stage_path", None)
            if path:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
                df._stage_path = None
