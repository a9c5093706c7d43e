"""Session, scratch-table and Arrow-batch helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Bytes that one Arrow batch may hold on its way to a Python worker.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000
_PACKAGE = Path(__file__).resolve().parent
_scratch: list[tuple[SparkSession, str, str]] = []
_owner = [""]
_shipped: set[str] = set()


def session(name: str = "quillon", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the operators expect."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes and make this package importable on executors."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) != str(BATCH_BYTES):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    on_path = {str(Path(p or ".").resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)}
    if app in _shipped or str(_PACKAGE.parent) in on_path or Path.cwd() == _PACKAGE.parent:
        return
    target = Path(tempfile.mkdtemp(prefix="quillon-ship-")) / "quillon.zip"  # read by the driver's file server only
    with zipfile.ZipFile(target, "w") as z:
        for p in _PACKAGE.rglob("*.py"):
            z.write(p, p.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one only where that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("quillon.scratch.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="quillon-")
            spark.conf.set("quillon.scratch.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back: lineage is cut, nothing sits on executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quillon-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    _scratch.append((spark, path, _owner[-1]))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the scratch table that df reads, once no plan needs it any more."""
    files = [f.rsplit("/", 1)[0] for f in df.inputFiles()]
    for spark, path, _ in [x for x in _scratch if any(f.endswith(x[1].split("://")[-1].lstrip("/")) for f in files)]:
        _delete(spark, path)


@contextmanager
def owned_by(owner: str) -> Iterator[None]:
    """Scratch tables that are made meanwhile belong to the owner."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def release_scratch(owner: str) -> None:
    """Delete the owner's scratch tables. DataFrames that read them must have been written."""
    for spark, path, of in list(_scratch):
        if of == owner:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path).getParent()
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _scratch[:] = [x for x in _scratch if x[1] != path]


@atexit.register
def _at_exit() -> None:
    for spark, path, _ in list(_scratch):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone by now
            return


def map_columns(df: DataFrame, outputs: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the output columns, computed batch by batch in Arrow; input columns of the same names are replaced.

    make runs once a task and returns the function from a batch to the arrays of the outputs, in order.
    """
    prepare(df.sparkSession)
    names = {f.name for f in outputs} | set(drop)
    kept = [f for f in df.schema if f.name not in names]
    schema = T.StructType(kept + list(outputs))
    keep = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            new = f(b)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + new, names=keep + [x.name for x in outputs])

    return df.mapInArrow(run, schema)


def flat_map(df: DataFrame, schema: T.StructType, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow with batches bounded by bytes."""
    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)
