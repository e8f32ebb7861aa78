"""Benchmark decontamination with an Aho-Corasick automaton.

The texts of a benchmark are normalised to words and cut into windows; one automaton over all windows (as sequences of
word numbers) reads each document once. As a step of the automaton is a word, the end of a match is a word position,
which is mapped to offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import binary_list

#: Bytes of benchmark text in one automaton; a larger benchmark is read by several automata, one after the other.
AUTOMATON_BYTES = 8 << 20

#: A-Z to a-z; 0-9, a-z and all bytes beyond ASCII stay; every other byte separates words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes | None) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.translate(_WORD_BYTES).split() if text else []


def windows(text: bytes | None, size: int) -> list[tuple[bytes, ...]]:
    """All runs of ``size`` words; a text of fewer words is one window, a text of none has none."""
    w = words(text)
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


class _Scanner:
    def __init__(self, items: list[tuple[str, bytes]], size: int):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        self.empty = True
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            for window in windows(text, size):
                key = tuple([self.number.setdefault(w, len(self.number) + 1) for w in window])
                found.setdefault(key, set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, names in found.items():
            self.automaton.add_word(key, (len(key), names))
            self.empty = False
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged runs [from, to) of hit words, in order, and the items of which a window occurs."""
        if self.empty or not text_words:
            return [], set()
        get, runs, names = self.number.get, [], set()
        for end, (n, own) in self.automaton.iter(tuple([get(w, 0) for w in text_words])):
            runs.append((end + 1 - n, end + 1))
            names |= own
        return merged(runs), names


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _spans(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words as offsets (in characters) in the text as it was."""
    at = [m.span() for m in _ORIGINAL_WORD.finditer(text.decode("utf-8", "replace"))]
    return [{"from": at[a][0], "to": at[b - 1][1]} for a, b in runs]


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = 13, automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """One row for each row of ``docs``: its words hit by benchmark windows and the items they come from.

    Columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (some hit, and a twentieth of the words or
    more), items, spans (offsets of hit runs in the original text, in characters).

    A null or empty text has no words and is never contaminated. Null or wordless items have no window, an item with a
    null id is named ``null``; an item of fewer words than the window is one window. Repeated rows are judged one by
    one, null ids too. Other columns of either table play no part. An empty benchmark hits nothing.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).cast("binary").alias("body")).where("body is not null")
    size = items.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(1, -(-int(size) // automaton_bytes))
    spark = docs.sparkSession
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.expr("cast(array() as array<int>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, text binary, n_words long, n_hit long, hits array<int>, items array<string>, items_sha256 string, spans array<struct<`from`:int,`to`:int>>"
    for k in range(shards):
        # A shard of the benchmark: automaton_bytes on average, and one item at least.
        mine = items if shards == 1 else items.where(F.pmod(F.xxhash64("item", "body"), F.lit(shards)) == k)
        pool = spark.sparkContext.broadcast([(r["item"], bytes(r["body"])) for r in mine.collect()])
        out = out.mapInArrow(_scan(pool, window, k == shards - 1), schema)
        if k < shards - 1:
            out = out.select("doc_id", "text", "hits", "items")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items", "spans",
    )


#: The automaton that a worker process has made last.
_SCANNERS: dict[str, _Scanner] = {}


def _scan(pool, window: int, last: bool):
    name = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        if name not in _SCANNERS:
            _SCANNERS.clear()
            _SCANNERS[name] = _Scanner(pool.value, window)
        scanner = _SCANNERS[name]
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            rows = {k: [] for k in ("text", "n_words", "n_hit", "hits", "items", "items_sha256", "spans")}
            texts = binary_list(batch.column("text"))
            for text, hits, names in zip(texts, batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True):
                w = words(text)
                runs, found = scanner.scan(w)
                if hits:
                    runs = merged(runs + list(zip(hits[::2], hits[1::2], strict=True)))
                found = sorted(found.union(names))
                rows["text"].append(None if last else text)
                rows["n_words"].append(len(w))
                rows["n_hit"].append(sum(b - a for a, b in runs))
                rows["hits"].append([x for run in runs for x in run])
                rows["items"].append(found)
                rows["items_sha256"].append(hashlib.sha256(",".join(found).encode()).hexdigest() if found else empty)
                rows["spans"].append(_spans(text, runs) if last and runs else [])
            kinds = {"text": pa.binary(), "n_words": pa.int64(), "n_hit": pa.int64(), "hits": pa.list_(pa.int32()), "items": pa.list_(pa.string()), "items_sha256": pa.string(), "spans": pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, kinds[k]) for k, v in rows.items())], names=["doc_id", *rows])

    return run
