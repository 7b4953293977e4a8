"""Helpers shared by the operators of this package."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A given table, read by Spark, narrowed to ``cols``."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id written as text leaves no remainder by 5
    (a null id is not held out, and not learned from either)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))


def learnable(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) != 0


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    while stem in df.columns:
        stem += "_"
    return stem


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_rows(batches: Iterable[pa.RecordBatch], col: str = "text", slice_rows: int = 512
              ) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Arrow batches in slices of a few hundred rows with their texts as
    Python strings, so that only one slice of texts is unpacked at a time
    (null becomes the empty text)."""
    for batch in batches:
        for at in range(0, batch.num_rows, slice_rows):
            part = batch.slice(at, slice_rows)
            yield part, [t or "" for t in part.column(part.schema.get_field_index(col)).to_pylist()]


def crc(data: bytes, start: int = 0) -> int:
    return zlib.crc32(data, start) & 0xFFFFFFFF


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this library to the Python workers through Spark's own file
    server, as ``--py-files`` does, once per application: workers then import
    it wherever the driver program was started."""
    import os
    import tempfile
    import zipfile

    import quire

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(quire.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quire-lib-"), "quire_lib.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
