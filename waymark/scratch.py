"""Tables in the shared folder, which cut a lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset, a session whose executors are threads of the driver gets a
    folder of its own; any other session is refused, as no folder of one machine
    is shared by a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        path = tempfile.mkdtemp(prefix="waymark-")
        atexit.register(shutil.rmtree, path, True)
        _own[app] = "file://" + path
    return _own[app]


def scratch(spark: SparkSession) -> str:
    """Where this application's tables lie; they go when the driver ends."""
    return f"{shared_dir(spark)}/waymark/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    root.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(root)
    return path


def clear(spark: SparkSession, path: str | None = None) -> None:
    """Deletes one table, or all tables that this application has written; results not yet saved need them."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path or scratch(spark))
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def native_given_back(spark: SparkSession) -> None:
    """Has the driver's JVM give the native memory back that it has freed.

    Each plan that is compiled takes and frees some; the C library keeps what was
    freed, so that the driver grows over a session whatever its tables hold.  A JVM
    without the command for it, or with another C library, keeps its memory.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    named = jvm.java.lang.Class.forName

    def array(kind, *items):
        out = gateway.new_array(kind, len(items))
        for k, x in enumerate(items):
            out[k] = x
        return out

    try:
        # by reflection, as the server's own class is not open to calls
        kinds = [named(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given = array(jvm.java.lang.Object, name, "systemTrimNativeHeap", array(jvm.java.lang.Object), array(jvm.java.lang.String))
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        pass


class Stage:
    """Deletes, at its end, the tables written within it but for those it was told to keep."""

    def __init__(self, spark: SparkSession):
        self.spark, self.first, self.kept = spark, len(_made), set()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """written(), to outlive the stage."""
        df = written(df, name)
        self.kept.add(_made[-1])
        return df

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *_) -> None:
        for path in _made[self.first :]:
            if path not in self.kept:
                clear(self.spark, path)


def written(df: DataFrame, name: str, few: bool = True) -> DataFrame:
    """df as a table in the shared folder.

    few: small shuffled partitions are put together up to Spark's advisory size,
    so that a small table is few files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    key = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(key)
    try:
        if few:
            spark.conf.set(key, "false")
        df.write.parquet(path)
    finally:
        if few:
            spark.conf.set(key, before)
    native_given_back(spark)
    return spark.read.schema(df.schema).parquet(path)
