"""Session helpers: shared staging area, checkpoints and driver-side bounds.

Everything that must outlive a lost executor is written to the folder named by
``spark.checkpoint.dir``.  Only when that setting is absent *and* the master is
local (tests, single-box runs) a temporary folder is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it was counted and holds at most this many rows.
BROADCAST_ROWS = 200_000
#: ... and takes about so many bytes.
BROADCAST_BYTES = 64 << 20

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, _local_dirs[app], True)
    return _local_dirs[app]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the shared folder unless a checkpoint folder is set already."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark) + "/rdd")


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like a checkpoint, but columnar and compressed: later
    reads prune columns, and a lost executor costs a re-read, not a re-run.
    The table is removed when the application's file system handle closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``limit`` rows and about ``most_bytes`` bytes; reads no more than limit + 1 rows."""
    wide = [c for c, t in df.dtypes if t not in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz")]
    texts = sum((F.coalesce(F.length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0)) for c in wide), F.lit(8 * (len(df.columns) - len(wide))))
    rows, size = df.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(texts.cast("long")), F.lit(0))).first()
    return rows <= limit and size <= most_bytes
