"""Session construction and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import io
import json
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_OWN_ROOTS: dict[str, str] = {}


def build_session(master: str = "local[*]", app: str = "presswerk", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that is unset (tests on one
    machine) is a local folder made, one for each application.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _OWN_ROOTS:
            _OWN_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="presswerk-")
        root = _OWN_ROOTS[app]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{scratch_root(spark)}/presswerk/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage (a lost executor costs a re-read, not a re-computation) and gives the planner the
    true size, so that it broadcasts the table only if it is under ``autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with at least as many partitions as the cluster has cores, for maps that cost far more than the rows
    weigh. A table of many files has them already and is left as it is, so nothing is shuffled at size."""
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(wanted) if scan._jdf.rdd().getNumPartitions() < wanted else scan


def release(spark: SparkSession, path: str) -> None:
    """Delete one scratch table (missing tables are fine)."""
    files, target = _file_system(spark, path)
    files.delete(target, True)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file whole, on whatever file system the path names."""
    files, target = _file_system(spark, path)
    stream = files.create(target, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """One small file, or None if it isn't there."""
    files, target = _file_system(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies directly in a folder; a folder that isn't there is empty."""
    files, target = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(target)) if files.exists(target) else []


def make_folder(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.mkdirs(target)


class Numbered:
    """A small record as numbered files of a folder, of which the highest that is whole counts.

    A record is written under the next number and never changed, so a writer that dies leaves the last one in force.
    """

    def __init__(self, spark: SparkSession, path: str, name: str = "manifest") -> None:
        self.spark, self.path, self.name = spark, path, name

    def _numbers(self) -> list[int]:
        start, end = f"{self.name}-", ".json"
        found = (x[len(start) : -len(end)] for x in names_in(self.spark, self.path) if x.startswith(start) and x.endswith(end))
        return sorted(int(x) for x in found if x.isdigit())

    def read(self) -> dict | None:
        for number in reversed(self._numbers()):
            try:
                return json.loads(read_text(self.spark, f"{self.path}/{self.name}-{number}.json") or "")
            except json.JSONDecodeError:
                continue
        return None

    def write(self, record: dict, keep: int = 2) -> None:
        past = self._numbers()
        write_text(self.spark, f"{self.path}/{self.name}-{past[-1] + 1 if past else 1}.json", json.dumps(record))
        for number in past[: -(keep - 1)] if keep > 1 else past:
            release(self.spark, f"{self.path}/{self.name}-{number}.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Give the package to the Python workers, once for each application.

    The archive goes through the shared folder, so it works whatever folder or path the workers start with.
    """
    mark = f"presswerk.shipped.{spark.sparkContext.applicationId}"
    if spark.conf.get(mark, ""):
        return
    here = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(here.rglob("*.py")):
            archive.write(file, f"{here.name}/{file.relative_to(here)}")
    target = f"{scratch_root(spark)}/presswerk/code-{uuid.uuid4().hex}/presswerk.zip"
    files, path = _file_system(spark, target)
    stream = files.create(path)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    spark.sparkContext.addPyFile(target)
    spark.conf.set(mark, "yes")
