"""What the operators of this subpackage share: storage, hashing and word splitting."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltstone.sources.shared import new_folder, shared_dir, written  # noqa: F401 the operators take them from here

#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte as it is.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(column, modulus: int):
    """Remainder of the crc32 of an id written as text; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def binary_list(column) -> list:
    """An Arrow string or binary column as a list of bytes and None, without decoding."""
    import pyarrow as pa

    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def open_store(uri: str):
    """File system and path of a URI that driver and executors reach alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
