"""Readers and writers of tables, mappings and vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.contracts import check_covered
from ..operators.reshape import union_all

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table. Its schema is read from the footer once per process."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def read_table(spark: SparkSession, path: str | list[str], schema: str | None = None, sep: str = ",", columns: Sequence[str] | None = None) -> DataFrame:
    """Delimited text with a header, plain or gzip.

    With a schema nothing is inferred: columns are taken by their name in the header, in any order, and
    cast; other columns of the file are ignored. A name that the header lacks is an error, and so is a
    malformed row or value.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", False)
    if schema is None:
        df = reader.csv(path)
        return df.select(*columns) if columns else df
    wanted = StructType.fromDDL(schema)
    names = header(spark, path, sep)
    if missing := [f.name for f in wanted if f.name not in names]:
        raise ValueError(f"columns missing from the header: {', '.join(missing)}")
    by_place = StructType([StructField(n, wanted[n].dataType if n in wanted.names else StringType()) for n in names])
    df = reader.schema(by_place).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    return df.select(*(columns or wanted.names))


def header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of a delimited file."""
    return spark.read.option("header", True).option("sep", sep).csv(path).columns


def read_mapping(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """A JSON object as (key, value) rows."""
    parsed = F.from_json(F.col("value"), "map<string,string>")
    return spark.read.text(path, wholetext=True).select(F.explode(parsed).alias(key, value))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), sep: str = ",") -> None:
    """Write a new table; an existing folder is an error. ``fmt`` is parquet, csv or csv.gz."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt in ("csv", "csv.gz"):
        writer = writer.option("header", True).option("sep", sep)
        (writer.option("compression", "gzip") if fmt == "csv.gz" else writer).csv(path)
    else:
        raise ValueError(f"unknown format {fmt}")


RANGE = 1 << 20  # bytes of a file that are hashed together
UNPACKED = r"(?i)\.(gz|bz2|deflate|snappy|lz4|zst|zstd|xz|lzo)$"  # names that text readers unpack
BOM = b"\xef\xbb\xbf"


def file_hashes(spark: SparkSession, folder: str, names: Sequence[str], length: int = RANGE) -> DataFrame:
    """SHA-256 of every file below ``folder`` in the named files or folders, and the root over its ranges.

    ``file`` is the path below the folder. ``root`` is the SHA-256 over the hex digests of the file's ranges of
    ``length`` bytes, each written on a line: ranges that changed show in ``range_hashes``. The files are listed
    and read by Spark, from any store, in the pieces between their line feeds, and hashed piece by piece: a task
    holds a batch of pieces, not a file. Names that Spark's readers would unpack (``UNPACKED``) are read as one row
    each, so such a file may have at most 2 GB, and so may a piece. Empty files have no row.
    """
    paths = [f"{folder}/{n}" for n in names]
    by_piece = (
        spark.read.option("lineSep", "\n").text(paths)
        .where(~F.col("_metadata.file_path").rlike(UNPACKED))
        .select(
            F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("piece"),
        )
    )
    # Besides the line feeds between pieces, the reader leaves out a last one, and a byte order mark at the start.
    read = F.sum(F.length("piece")) + F.count(F.lit(1)) - 1
    left_out = by_piece.groupBy("path").agg((F.first("bytes") - read).alias("left_out"))
    # One row a file is broadcast: a shuffled join would lend its partitions to the next step, and lose them when re-planned.
    in_order = by_piece.join(F.broadcast(left_out), "path").repartition("path").sortWithinPartitions("path", "start", "place")
    hashed = in_order.mapInArrow(_hash_pieces(length), "path string, bytes long, sha256 string, range_hashes array<string>")

    whole = spark.read.format("binaryFile").load(paths).where(F.col("_metadata.file_path").rlike(UNPACKED))  # leaves the others out of the listing
    starts = F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(length))
    digests = F.transform(starts, lambda at: F.sha2(F.substring("content", at.cast("int") + 1, F.lit(length)), 256))
    hashed = hashed.unionByName(whole.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), digests.alias("range_hashes")))
    below = F.element_at(F.split("path", F.lit("/" + re.escape(folder.rstrip("/").split("/")[-1]) + "/"), 2), -1)
    return hashed.select(below.alias("file"), "bytes", "sha256", "range_hashes", F.sha2(F.array_join("range_hashes", "\n").cast("binary"), 256).alias("root"))


def _hash_pieces(length: int):
    """Digests of files whose pieces come in order; the last piece of a file may have no line feed behind it."""

    class Running:
        def __init__(self, path: str, size: int):
            self.path, self.size, self.done, self.whole, self.part, self.ranges = path, size, 0, hashlib.sha256(), hashlib.sha256(), []

        def add(self, data: memoryview) -> None:
            self.whole.update(data)
            while len(data):
                now = data[: length - self.done % length]
                self.part.update(now)
                self.done += len(now)
                data = data[len(now) :]
                if self.done % length == 0 or self.done == self.size:
                    self.ranges.append(self.part.hexdigest())
                    self.part = hashlib.sha256()

    def row(file: Running) -> pa.RecordBatch:
        if file.done == file.size - 1:
            file.add(memoryview(b"\n"))
        if file.done != file.size:
            raise ValueError(f"{file.path}: {file.done} of {file.size} bytes were read")
        return pa.RecordBatch.from_arrays(
            [pa.array([file.path]), pa.array([file.size], pa.int64()), pa.array([file.whole.hexdigest()]), pa.array([file.ranges], pa.list_(pa.string()))],
            ["path", "bytes", "sha256", "range_hashes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, waiting = None, bytearray()
        for batch in batches:
            for path, size, piece, left_out in zip(*[batch[c].to_pylist() for c in ("path", "bytes", "piece", "left_out")]):
                if file is None or path != file.path:
                    if file is not None:
                        file.add(memoryview(bytes(waiting)))
                        yield row(file)
                    file, waiting = Running(path, size), bytearray(BOM if left_out >= len(BOM) else b"")
                else:
                    waiting += b"\n"
                waiting += piece
                if len(waiting) >= length:
                    file.add(memoryview(bytes(waiting)))
                    waiting = bytearray()
        if file is not None:
            file.add(memoryview(bytes(waiting)))
            yield row(file)

    return run


def union_runs(runs: Mapping[str, DataFrame], tag: str = "run_tag") -> DataFrame:
    """Result tables of several runs in one table with the run's tag."""
    return union_all([df.withColumn(tag, F.lit(name)) for name, df in runs.items()])


def lookup_vectors(entities: DataFrame, vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Entities with their vector, and the check that none is missing."""
    return entities.join(vectors.select(key, vector), key), check_covered(entities, key, vectors, check="entities without vector")
