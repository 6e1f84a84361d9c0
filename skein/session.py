"""Session helpers: a tuned builder, package shipping and shared scratch tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def build_session(app: str = "skein", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and UTC time; cluster settings given from outside win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, so tasks can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="skein-ship-"), "skein_pkg.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(top, n)
                    z.write(p, os.path.join("skein", os.path.relpath(p, root)))
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)


#: Paths of tables and folders that this driver made, in order; what is left of them goes when it ends.
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, as in tests, may leave it unset and
    gets a temporary one; on a cluster that would be a different folder on each machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, "_skein_dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="skein-shared-")
            spark.sparkContext._skein_dir = base
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/skein/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to a table in the shared folder and read it back: cuts lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._skein_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a scratch path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made[:] = [m for m in _made if m[1] != path]


def drop(*frames: DataFrame) -> None:
    """Delete tables made by materialize() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_skein_path", None)
        if path:
            delete(df.sparkSession, path)


def mark() -> int:
    """How many scratch paths there are; see release()."""
    return len(_made)


def release(since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the scratch paths made since a mark, but for those to keep. Results that were not written or read yet need theirs."""
    for spark, path in list(_made[since:]):
        if path not in keep and spark.sparkContext._jsc is not None:
            delete(spark, path)


@atexit.register
def _at_end() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        release()
