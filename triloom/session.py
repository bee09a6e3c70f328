"""Session settings shared by tests, the bench and interactive use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 4, partitions: int = 8, app: str = "triloom", **conf: str) -> SparkSession:
    """A local session for tests; on a cluster the session comes from spark-submit, with a shared
    spark.checkpoint.dir. Here it is a temporary folder unless given."""
    import tempfile

    conf.setdefault("spark__checkpoint__dir", tempfile.mkdtemp(prefix="triloom-"))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context, wherever the driver imported it from."""
    import shutil
    import tempfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_triloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as stage:
        shutil.copytree(package, f"{stage}/src/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='triloom-')}/triloom", "zip", f"{stage}/src")
    context.addPyFile(archive)
    context._triloom_shipped = True


#: What a task reads of files or of shuffled rows at most, and input bytes for which a shuffle gets one partition.
_TASK, _SHARE = 16 << 20, 4 << 20
#: Tasks that list the files of a read: Spark's own limit is a task for each of up to 10,000 paths.
_LISTING = 64


def bounded_tasks(spark: SparkSession, folder: str) -> None:
    """Let the number of tasks, not their size, grow with the tables of a folder: shuffles begin with partitions
    by the folder's bytes, which adaptive execution joins up to _TASK, and files are cut at twice that. Settings
    of the session that are finer already stay."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    now = int(spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if -(-size // _SHARE) > now:
        spark.conf.set(first, str(-(-size // _SHARE)))
    to_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", _TASK), ("spark.sql.files.maxPartitionBytes", 2 * _TASK)):
        if to_bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    if int(spark.conf.get(listing)) > _LISTING:
        spark.conf.set(listing, str(_LISTING))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint
    folder. Only a local session that has neither gets a temporary one."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="triloom-")
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    import uuid

    top = f"{shared_root(spark)}/triloom-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{top}/{name}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read back: computed once, and its lineage ends there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """A small text file on whatever file system the path names. A local one gets no checksum file
    beside it, as people edit such files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(p, overwrite)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if files.getScheme() == "file" and hasattr(files, "getRaw"):
        files.getRaw().delete(files.getChecksumFile(files.makeQualified(p)), False)
