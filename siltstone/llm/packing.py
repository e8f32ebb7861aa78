"""Best-two-fit packing of token sequences.

A piece's place depends only on its length, so the bins are made from the histogram of lengths, which has as many
entries as a sequence has tokens: a pattern (how many pieces of which lengths) and how often it is used. A pattern is
filled greedily, the largest piece that fits first; then its smallest piece is replaced by two unpacked ones if they
fill the widened gap more tightly. It is used as often as the lengths last, so that a pattern halves the rest of at
least one length and the number of patterns doesn't grow with the data but with the logarithm of its counts.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import binary_list, written
from siltstone.llm.tokens import encoder

#: Pieces of one length are numbered within buckets of about so many pieces, so that no length lands in one task.
BUCKET_PIECES = 512


class _Lengths:
    """Counts by length with "largest length up to x" as bit operations."""

    def __init__(self, counts: dict[int, int]):
        self.count = {n: c for n, c in counts.items() if c > 0}
        self.bits = sum(1 << n for n in self.count)

    def below(self, x: int) -> int:
        """The largest length of at most x that is left, or 0."""
        return max(0, (self.bits & ((1 << (x + 1)) - 1)).bit_length() - 1) if x > 0 else 0

    def take(self, n: int, k: int) -> None:
        self.count[n] -= k
        if not self.count[n]:
            del self.count[n]
            self.bits ^= 1 << n


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times used, [(length, pieces in the bin)]) for all pieces; lengths from 1 to ``capacity``."""
    left, out = _Lengths(counts), []
    while left.count:
        bin_: dict[int, int] = {}
        gap = capacity
        free = _Lengths(left.count)
        while n := free.below(gap):
            k = min(free.count[n], gap // n)
            bin_[n] = bin_.get(n, 0) + k
            free.take(n, k)
            gap -= n * k
        if gap and len(bin_) + sum(bin_.values()) > 2:
            smallest = min(bin_)
            best, pair, room = smallest, None, gap + smallest
            a = free.below(room - 1)
            while a and 2 * a > best and best < room:
                b = free.below(min(a, room - a))
                if b == a and free.count[a] < 2:
                    b = free.below(a - 1)
                if b and a + b > best:
                    best, pair = a + b, (a, b)
                a = free.below(a - 1)
            if pair:
                bin_[smallest] -= 1
                bin_ = {n: k for n, k in bin_.items() if k}
                for n in pair:
                    bin_[n] = bin_.get(n, 0) + 1
        times = min(left.count[n] // k for n, k in bin_.items())
        for n, k in bin_.items():
            left.take(n, k * times)
        out.append((times, sorted(bin_.items(), reverse=True)))
    return out


def layout(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, after the last rank, pieces in the bin, first sequence, first offset) of each pattern's lengths."""
    rows, used, sequence = [], dict.fromkeys(counts, 0), 0
    for times, bin_ in patterns(counts, capacity):
        offset = 0
        for n, k in bin_:
            rows.append((n, used[n], used[n] + k * times, k, sequence, offset))
            used[n] += k * times
            offset += n * k
        sequence += times
    return rows


def pieces_of(docs: DataFrame, *, tokenizer_path: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with the end id, cut only where it is too long."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encode, end = encoder(tokenizer_path, words=True).ids, np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            row, out = [], []
            for i, text in enumerate(binary_list(batch.column(1))):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    out.append((k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def pack(
    docs: DataFrame, *, tokenizer_path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows and null ids are packed like any other row. Sequences are
    numbered from 0 and hold their pieces without gaps. An empty table has no sequence.
    """
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, tokenizer_path=tokenizer_path, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col), "pieces")
    buckets = max(1, -(-pieces.count() // BUCKET_PIECES))
    placed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    # Ranks within a length: ranks within (bucket, length), after the counts of the buckets before.
    counts = placed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(layout(total, capacity), "length long, low long, high long, uses long, first_sequence long, first_offset long")
    ranked = placed.withColumn("r", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1).join(before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["bucket", "length"]).withColumn("rank", F.col("r") + F.col("before"))
    x = F.col("rank") - F.col("low")
    # The plan has a row for each length of each pattern: bounded by the capacity and the logarithm of the counts.
    return ranked.join(F.broadcast(plan), "length").where("rank >= low and rank < high").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(x / F.col("uses"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (x % F.col("uses")) * F.col("length")).cast("long").alias("offset"),
    )
