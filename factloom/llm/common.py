"""What several operators share: table access, the shared folder, words and hashes as arrays.

Conventions of every operator here: it reads only the columns it names, so other columns of the input may have any
name; a null text counts as empty; rows with a null id are kept and get a result of their own; repeated rows each get
a row; an empty table gives an empty result of the same schema."""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import checkpoint_root

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SCRATCH: list[tuple[str, str | None]] = []  # folders that `written` and `bucketed` made in this driver, and their tables


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, *needed: DataFrame) -> None:
    """Remove the intermediate tables of operators whose results have been written since, but none that a `needed` table
    still reads. For a chain of stages, each of which reads only what the one before it has written."""
    in_use = [f for df in needed for f in df.inputFiles()]
    for entry in list(_SCRATCH):
        folder, name = entry
        plain = folder.split("://")[-1].removeprefix("file:")
        if any(plain in f for f in in_use):
            continue
        _SCRATCH.remove(entry)
        if name is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, partition_by: list[str] | None = None, reader: SparkSession | None = None) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back (by `reader`, else by its own session), so that
    later jobs survive lost executors."""
    path = shared_folder(df.sparkSession, label)
    _SCRATCH.append((path, None))
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int) -> SparkSession:
    """A session beside `spark` with its settings, whose scans and Python batches hold at most `rows` rows: for tables
    with large values. The caller's session stays as it is."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    own.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))
    return own


def bucketed(df: DataFrame, key: str, label: str, reader: SparkSession | None = None) -> DataFrame:
    """`df` written once as a table bucketed by `key`: joins on the key leave its rows where they are. Read back by
    `reader`, else by its own session."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    path = shared_folder(spark, label)
    _SCRATCH.append((path, name))
    writer = df.write.bucketBy(partitions(spark), key).option("path", path).option("compression", "zstd")
    writer.saveAsTable(name)
    return (reader or spark).table(name)


ROW = ["_block", "_row"]


def block_of(row: str) -> Column:
    """The task that numbered a row: the upper bits of its number."""
    return F.shiftright(F.col(row), 33)


def numbered(df: DataFrame, label: str, reader: SparkSession | None = None) -> DataFrame:
    """`df` with ROW columns, written once so that the numbers stay, bucketed by block: a task writes one file, and joins
    on ROW leave these rows where they are. Columns of these names are replaced: see `put_aside`."""
    (reader or df.sparkSession).conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # a bucket key may be part of a join key
    return bucketed(df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_block", block_of("_row")), "_block", label, reader)


def put_aside(df: DataFrame, own: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns that have one of our `own` names renamed, and the name that each column has now."""
    taken = {c.lower() for c in df.columns} | {c.lower() for c in own}
    names = {}
    for c in df.columns:
        name = c
        while name.lower() in (taken if name != c else {o.lower() for o in own}):
            name = f"given_{name}"
        names[c] = name
    return df.toDF(*names.values()), names


def given_back(names: dict[str, str]) -> list[Column]:
    """The columns of an input that was `put_aside`, under their own names."""
    return [F.col(f"`{now}`").alias(c) for c, now in names.items()]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hashes of its two parts."""
    return mix(left * _STEP + right)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` neighbouring items, by doubling: log2(size) passes."""
    whole, have, power, span = None, 0, h, 1
    while True:
        if size & span:
            whole = power if whole is None else chain(whole[: len(power) - have], power[have : have + len(whole)]) if len(power) > have else power[:0]
            have += span
            if have == size:
                return whole
        power = chain(power[:-span], power[span:]) if len(power) > span else power[:0]
        span *= 2


def ascii_lower(texts: pa.Array) -> pa.Array:
    """A-Z to a-z; every other character stays."""
    if not len(texts):
        return texts
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    upper = (data >= 65) & (data <= 90)
    lowered = pa.py_buffer((data + (upper * np.uint8(32))).tobytes())
    return pa.Array.from_buffers(texts.type, len(texts), [None, texts.buffers()[1], lowered], offset=texts.offset)


def filled(column: pa.Array) -> pa.Array:
    """Text without nulls, with 64-bit offsets."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts in order, and the number of words of each text."""
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    owner = pc.list_parent_indices(parts).to_numpy()
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(full)), np.bincount(owner[full], minlength=len(texts))


def byte_hash(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: every byte is weighted by its place, then scrambled."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    starts = offsets[:-1] - offsets[0]
    sizes = np.diff(offsets)
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
    values = mix((data.astype(np.uint64) + np.uint64(1)) * MULTIPLIER + place * _STEP)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return mix(total[starts + sizes] - total[starts] + sizes.astype(np.uint64))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of words of each text; each distinct word is hashed once."""
    words, counts = split_words(texts)
    coded = words.dictionary_encode()
    return byte_hash(coded.dictionary)[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64), counts
