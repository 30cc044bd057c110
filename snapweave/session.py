"""Session helpers: a local session for tests and benches, and the checkpoint folder."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on. AQE re-plans joins at run time (broadcast when a
# side turns out small, split skewed partitions of a sort-merge join) and coalesces small shuffle
# partitions.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "snapweave") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    for k, v in JOB_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for materialised tables: ``spark.checkpoint.dir``, a file system that the driver
    and all executors share. A private scratch folder is made only when that setting is absent and
    the session is a single local process (tests); anywhere else an unset folder raises."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    if sc is not None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        configured = configured or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if sc is None or not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="snapweave-ckpt-", dir=os.environ.get("TMPDIR"))
    if sc is not None:
        sc.setCheckpointDir(configured)
        return sc._jsc.sc().getCheckpointDir().get()
    spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    One job computes and writes it (``Dataset.checkpoint`` would compute it twice: once to count,
    once to write). The result survives executor loss, its lineage is the file scan, and the table
    is columnar, so later readers prune columns and push filters into it."""
    spark = df.sparkSession
    path = scratch_path(spark)
    with freed_shuffles(spark):
        df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, known to :func:`drop_materialized`."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    _written(spark).append(path)
    return path


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of the queries inside are removed as each one ends: their results are tables
    in the shared folder, so nothing reads those files again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def drop_table(df: DataFrame) -> None:
    """Delete the table behind a frame that :func:`cut_lineage` returned, once all that reads it
    has been written elsewhere."""
    spark, reg = df.sparkSession, _written(df.sparkSession)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        known = next((p for p in reg if path.rstrip("/").endswith(p.rsplit("/", 1)[1])), None)
        if known:
            reg.remove(known)
            _delete(spark, known)


def _delete(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p) and fs.delete(p, True))


def _written(spark: SparkSession) -> list:
    reg = getattr(spark, "_snapweave_tables", None)
    if reg is None:
        reg = spark._snapweave_tables = []
    return reg


def materialized_mark(spark: SparkSession) -> int:
    """A position in the session's list of written tables, for :func:`drop_materialized`."""
    return len(_written(spark))


def drop_materialized(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables :func:`cut_lineage` wrote in this session after position ``since``
    (call once the outputs that read them are written: frames built on them cannot be evaluated
    afterwards). Returns how many were removed."""
    reg = _written(spark)
    n = 0
    while len(reg) > since:
        n += _delete(spark, reg.pop())
    return n


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers (pandas UDFs refer to it by module path):
    zip it once per SparkContext and ``addPyFile`` it, as ``--py-files`` would on a cluster."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect
        sc = None
    holder = sc if sc is not None else spark
    if getattr(holder, "_snapweave_shipped", False):
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, zpath = tempfile.mkstemp(prefix="snapweave-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, dirnames, filenames in os.walk(pkg):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for f in filenames:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    if sc is not None:
        sc.addPyFile(zpath)
    else:
        spark.addArtifacts(zpath, pyfile=True)
    holder._snapweave_shipped = True
