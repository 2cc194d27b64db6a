"""Session settings and durable intermediate tables."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_made: list[tuple[SparkSession, str]] = []


def build_session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", app: str = "recordloom") -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Only where the setting is missing and everything runs on one machine (tests)
    a temporary folder takes its place; a cluster without it is refused.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if found:
        return found.rstrip("/")
    jvm_dir = spark.sparkContext.getCheckpointDir()
    if jvm_dir:
        return jvm_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='recordloom-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/recordloom/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete_path(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.getFileStatus(where).isFile()


def list_files(spark: SparkSession, folder: str) -> dict[str, list]:
    """Data files under a folder (or the file itself), with length and time of change; names that begin with ``_`` or ``.`` are none."""
    fs, where = _at(spark, folder)
    found = fs.listFiles(where, True)
    out = {}
    while found.hasNext():
        f = found.next()
        if f.getPath().getName()[0] not in "_.":
            out[f.getPath().toString()] = [f.getLen(), f.getModificationTime()]
    return out


def open_tail(spark: SparkSession, path: str, length: int, block: int = 1 << 20) -> str:
    """What stands behind the last line end of a text file: '' if its last line is ended. Reads from the end, a block at a time."""
    fs, where = _at(spark, path)
    stream, held, at = fs.open(where), b"", length
    try:
        while at > 0 and b"\n" not in held:
            step = min(block, at)
            at -= step
            stream.seek(at)
            held = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, step)) + held
    finally:
        stream.close()
    return held.rpartition(b"\n")[2].decode("utf-8", "replace")


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Rename on the shared file system; the target must not exist."""
    fs, to = _at(spark, target)
    fs.mkdirs(to.getParent())
    if not fs.rename(_at(spark, source)[1], to):
        raise OSError(f"cannot move {source} to {target}")


def put_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small text file, whole or not at all; False if it is there already."""
    fs, where = _at(spark, path)
    if fs.exists(where):
        return False
    part = f"{path}.{uuid.uuid4().hex}.part"
    out = fs.create(_at(spark, part)[1])
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(_at(spark, part)[1], where):
        delete_path(spark, part)
        return False
    return True


def get_text(spark: SparkSession, path: str) -> str:
    """A small text file, from wherever the session can read."""
    return spark.read.text(path, wholetext=True).first()[0]


def kept(spark: SparkSession, name: str, sources: list[str], build) -> str:
    """The folder of something derived from files, built once (``build(folder)``) and kept until the files change.

    It outlives the session, in the shared folder; its name holds a digest of
    the files' names, lengths and times of change. A build that dies leaves
    nothing: the folder is moved to its name when it is whole.
    """
    state = repr(sorted((f, *v) for s in sources for f, v in list_files(spark, s).items()))
    path = f"{shared_dir(spark)}/recordloom-kept/{name}-{hashlib.sha256(state.encode()).hexdigest()[:32]}"
    if not path_exists(spark, path):
        part = new_path(spark, name)
        build(part)
        try:
            move_path(spark, part, path)
        except OSError:
            if not path_exists(spark, path):  # else another session was first
                raise
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Cuts the lineage, so later stages survive lost executors without
    recomputing what came before; unlike a cached or locally checkpointed
    frame nothing of it lives in an executor. Removed by ``release``, or when
    Python ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_made() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far: for long drivers, once the results made from them are stored."""
    mine = [m for m in _made if m[0] is spark]
    _made[:] = [m for m in _made if m[0] is not spark]
    for _, path in mine:
        delete_path(spark, path)


def spread(df: DataFrame, rows: int, *keys: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """``df`` hashed by ``keys`` into as many tasks as its rows need, where the session's shuffle partitions are too few."""
    tasks = -(-rows // rows_per_task)
    return df.repartition(tasks, *keys) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def task_count(rows: int, spark: SparkSession, rows_per_task: int, least_rows: int = 20_000) -> int:
    """Tasks so that none gets over ``rows_per_task`` rows, yet all cores work."""
    need = -(-rows // rows_per_task)
    useful = min(spark.sparkContext.defaultParallelism, -(-rows // least_rows))
    return max(1, need, useful)
