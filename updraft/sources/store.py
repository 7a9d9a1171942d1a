"""Training buffer and model storage.

Both keep versions in folders of their own, named in a list whose newest entry
counts. An entry is one small file, written after everything it names, so it is the
commit point: a writer that stops earlier leaves the version before it in force.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from updraft import constants as K
from updraft.functions.rules import plausible_coordinates
from updraft.schema import SAMPLES, SchemaMismatch, require_columns

ACTIVE, SET_ASIDE = "active", "set aside"
BUFFERS = "buffer bigint, status string, reason string, features array<string>"
MODELS = "bench_score double, features array<string>, model string"
#: Models that stay on disk, the serving one included: readers may still be loading the one before.
KEPT_MODELS = 2


# --- Lists of versions --------------------------------------------------------

def _entries(spark: SparkSession, path: str) -> list[Row]:
    """Committed entries of a list, oldest first."""
    try:
        return spark.read.parquet(path).orderBy("version").collect()
    except AnalysisException:
        return []


def _commit(spark: SparkSession, path: str, version: int, row: tuple, schema: str) -> None:
    """Add an entry: one file, which its writer renames into place when it is whole."""
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any file system Spark reaches; nothing happens if it is not there."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


# --- Training buffer ----------------------------------------------------------

def _buffers(path: str) -> str:
    return f"{path}/buffers"


def _data(path: str, number: int) -> str:
    return f"{path}/data-{number}"


def _fault(spark: SparkSession, path: str, entry: Row, features: Sequence[str]) -> str | None:
    """Why the rows of a buffer cannot be used, or None."""
    if tuple(entry["features"]) != tuple(features):
        return f"{len(entry['features'])} features, not {len(features)}"
    try:
        require_columns(spark.read.parquet(_data(path, entry["buffer"])), SAMPLES.fieldNames(), "buffer")
    except SchemaMismatch as problem:
        return f"wrong columns: {problem}"
    except Exception as problem:     # whatever a damaged file makes the reader raise
        return f"unreadable: {type(problem).__name__}"
    return None


def current_buffer(spark: SparkSession, path: str, features: Sequence[str] = K.FEATURES) -> int | None:
    """Number of the buffer in force, or None when there is none that can be used.

    A buffer of another feature layout or one that cannot be read is set aside: its
    rows stay where they are, and an entry says why. The next append starts a new one.
    """
    entries = _entries(spark, _buffers(path))
    if not entries or entries[-1]["status"] != ACTIVE:
        return None
    last = entries[-1]
    reason = _fault(spark, path, last, features)
    if reason is None:
        return last["buffer"]
    _commit(spark, _buffers(path), last["version"] + 1, (last["buffer"], SET_ASIDE, reason, last["features"]), BUFFERS)
    return None


def append_buffer(samples: DataFrame, path: str, features: Sequence[str] = K.FEATURES) -> None:
    """Append labelled samples, partitioned by sample date, to the buffer in force or to a fresh one."""
    require_columns(samples, SAMPLES.fieldNames(), "samples")
    spark = samples.sparkSession
    number = current_buffer(spark, path, features)
    entries = _entries(spark, _buffers(path))
    fresh = number is None
    if fresh:
        number = 1 + max([e["buffer"] for e in entries], default=-1)
    # The rows of a fresh buffer may lie there from a writer that stopped before its entry: they are replaced.
    (samples.select(*SAMPLES.fieldNames())
            .withColumn("date", F.to_date("sample_ts"))
            .repartitionByRange("date", "seq")
            .write.mode("overwrite" if fresh else "append").partitionBy("date").parquet(_data(path, number)))
    if fresh:
        version = 1 + max([e["version"] for e in entries], default=-1)
        _commit(spark, _buffers(path), version, (number, ACTIVE, None, list(features)), BUFFERS)


def read_buffer(spark: SparkSession, path: str, box=(-90.0, 90.0, -180.0, 180.0),
                features: Sequence[str] = K.FEATURES) -> DataFrame | None:
    """The rows of the buffer in force, or None. Rows whose coordinates are not real are dropped."""
    number = current_buffer(spark, path, features)
    if number is None:
        return None
    stored = spark.read.parquet(_data(path, number))
    return stored.select(*SAMPLES.fieldNames()).filter(plausible_coordinates(box=box))


def set_aside(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """(number, reason, folder) of the buffers that were set aside."""
    return [(e["buffer"], e["reason"], _data(path, e["buffer"])) for e in _entries(spark, _buffers(path))
            if e["status"] == SET_ASIDE]


def newest_samples(samples: DataFrame, limit: int = K.MAX_BUFFER) -> DataFrame:
    """The newest rows of the rolling buffer."""
    return samples.orderBy(F.col("seq").desc()).limit(limit)


# --- Models ---------------------------------------------------------------------

@dataclass(frozen=True)
class StoredModel:
    """A fitted pipeline with the score and feature width it was saved with."""

    model: PipelineModel
    bench_score: float | None
    features: tuple[str, ...]


def save_model(spark: SparkSession, model: PipelineModel, path: str,
               bench_score: float | None, features=K.FEATURES) -> None:
    """Save a fitted pipeline in a folder of its own, then the entry that puts it and its score in force."""
    entries = _entries(spark, f"{path}/registry")
    version = 1 + max([e["version"] for e in entries], default=-1)
    folder = f"{path}/model-{version}"
    model.write().overwrite().save(folder)
    _commit(spark, f"{path}/registry", version, (bench_score, list(features), folder), MODELS)
    for old in entries[:-(KEPT_MODELS - 1) or None]:
        # The entry goes first, so none ever names a model that is gone.
        delete_path(spark, f"{path}/registry/version={old['version']}")
        delete_path(spark, old["model"])


def load_model(spark: SparkSession, path: str, features=K.FEATURES) -> StoredModel | None:
    """The model in force with its own score, or None when absent or fitted on other features."""
    entries = _entries(spark, f"{path}/registry")
    if not entries or tuple(entries[-1]["features"]) != tuple(features):
        return None
    last = entries[-1]
    return StoredModel(PipelineModel.load(last["model"]), last["bench_score"], tuple(features))
