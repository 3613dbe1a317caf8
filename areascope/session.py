"""Spark session and cluster-shared storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults that hold from local tests up to a large cluster: AQE re-plans
# shuffles at runtime (coalesces small partitions, splits skewed join
# partitions, converts joins with a small measured side to broadcast joins).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "areascope",
                shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster leave ``master`` unset and let spark-submit decide.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if (master or "").startswith("local"):
        # Wide generated methods (many expressions fused by whole-stage codegen)
        # exceed HotSpot's 8000-byte JIT limit and would run interpreted.
        settings["spark.driver.extraJavaOptions"] = "-XX:-DontCompileHugeMethods"
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for reliable checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only when that is unset
    (local tests) a private scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="areascope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and truncate its lineage.

    Survives executor loss (unlike cached or locally checkpointed blocks).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def discard_checkpoint(df: DataFrame) -> None:
    """Deletes the files of a ``cut_lineage`` table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep_table(df: DataFrame, kind: str) -> DataFrame:
    """Materialise a wide ``df`` as Parquet in the shared checkpoint folder, once, and read it back.

    Survives executor loss like ``cut_lineage``; repeated texts are stored once and readers take only their columns.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{kind}_{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def compile_stages(spark: SparkSession) -> None:
    """Keep stages out of the JVM's interpreter.

    A stage whose generated method passes 8000 bytes is never compiled by HotSpot. With this limit such a stage runs
    operator by operator, whose methods are compiled. A limit that the session sets itself stays.
    """
    if spark.conf.get(_METHOD_LIMIT) == "65535":
        spark.conf.set(_METHOD_LIMIT, "8000")


_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``areascope`` importable in executor Python workers (once per context).

    Functions run by ``mapInPandas`` / ``applyInPandas`` / ``pandas_udf`` are
    pickled by reference to this package. On a cluster the package is shipped
    at submit time (``spark-submit --py-files areascope.zip`` or installed in
    the executor image), so nothing is done there. In local mode (tests, the
    driver's checks) a zip of the package is added to the context, exactly
    what ``--py-files`` would do.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or not sc.master.startswith("local"):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(root)
    fd, path = tempfile.mkstemp(prefix="areascope-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
