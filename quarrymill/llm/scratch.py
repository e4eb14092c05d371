"""Tables written once to the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Folders whose tables a result may still read, with their session; and those made within a ``cleared`` block.
_OPEN: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where the session names none, a fresh local one, in local mode only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("quarrymill.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarrymill-")
        spark.conf.set("quarrymill.checkpoint.dir", root)
    return root.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2 MB (or one row), so that memory doesn't follow the length of texts, unless the session says otherwise."""
    if not spark.sparkContext.getConf().contains(ARROW_BYTES):
        spark.conf.set(ARROW_BYTES, str(2 << 20))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clear_all() -> None:
    for root, spark in list(_OPEN.items()):
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(spark, root)


@contextlib.contextmanager
def cleared() -> Iterator[None]:
    """Removes all tables that operators write within the block; their results must have been written by its end."""
    before = set(_OPEN)
    yield
    for root in [r for r in _OPEN if r not in before]:
        _delete(_OPEN.pop(root), root)


class Scratch:
    """Intermediate tables of one operator call.

    A table written here cuts lineage and survives the loss of any executor, since every executor sees the folder. Tables
    that a lazy result still reads are removed by ``cleared`` or when the driver ends, the others as soon as they are of
    no further use.
    """

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/quarrymill/{name}-{uuid.uuid4().hex}"
        _OPEN[self.root] = spark

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        df.write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))

    def close(self) -> None:
        """Removes everything."""
        if _OPEN.pop(self.root, None):
            _delete(self.spark, self.root)
