"""Small helpers that every operator of this subpackage shares: column hygiene, size-checked broadcasts, table access."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """``df`` with column names that can't be confused.

    Spark resolves names without regard to case, so an extra column ``TEXT`` beside ``text`` makes ``text`` ambiguous.
    For each required name the first column spelled exactly so wins (else the first that differs only by case); every
    later column whose name was already taken gets the suffix ``_2``, ``_3`` ... Missing required columns raise.
    """
    names, wanted = list(df.columns), {}
    for r in required:
        hits = [i for i, n in enumerate(names) if n == r] or [i for i, n in enumerate(names) if n.lower() == r.lower()]
        if not hits:
            raise ValueError(f"column {r!r} is missing; there are {names}")
        wanted[hits[0]] = r
    taken = {r.lower() for r in wanted.values()}
    out = []
    for i, n in enumerate(names):
        if i in wanted:
            out.append(wanted[i])
            continue
        new, k = n, 1
        while new.lower() in taken:
            k += 1
            new = f"{n}_{k}"
        taken.add(new.lower())
        out.append(new)
    return df if out == names else df.toDF(*out)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name += "_"
    return name


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows; otherwise as it is, for a shuffled join.

    The count is an action: ``df`` should be cheap or already written.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Rows that the JVM puts in one Arrow batch at most: whole texts are long, and several batches are in flight for each task.
BATCH_ROWS = 512


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; its session is told to make Arrow batches of at most BATCH_ROWS rows (a smaller setting stays)."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


#: Rows and bytes of an Arrow batch that a kernel works on at once, on average.
SLICE_ROWS, SLICE_BYTES = 2048, 4 << 20


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of bounded size, without empty ones: kernels need many times the memory of what they work on."""
    for b in batches:
        step = max(1, min(SLICE_ROWS, b.num_rows * SLICE_BYTES // max(1, b.nbytes)))
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def columns_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """For each slice of the Arrow batches the named columns as Arrow arrays."""
    for b in sliced(batches):
        yield tuple(b.column(b.schema.get_field_index(n)) for n in names)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset in a session on one machine, as in tests, a folder below the warehouse directory is taken; on a cluster it
    has to be set.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master or ""
    if not where and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, whatever file system it is on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that its lineage ends there."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the DataFrames that are made within are removed as soon as an action on them ends.

    Otherwise they stay until the driver happens to collect its garbage, and those of all iterations lie on the disks together. What
    comes out of an action must not be computed from those files again: for results sent to the driver, and for ``cut``.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
