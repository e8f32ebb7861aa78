"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The units are characters (code points), in n-grams of five. Counts, continuation counts and contexts' totals are Spark's;
interpolation is done in shards by the last characters. What comes out is a table of the seen n-grams' bits and of the
contexts' back-off weights, packed shard by shard where it is made, and written to the folder that driver and executors
share; a worker reads it from there, and none of it passes through the driver. Its rows are the different n-grams of five characters and fewer, whose number grows much
more slowly than the text, so that a document's perplexity is looked up where the document is. A document is kept if its
perplexity is at most a high quantile of its language's trusted documents. All of these make up the model, and all of
them the quantiles: they are dealt to two halves by a hash of the id, and for the quantiles each half is judged by a
model of the other, so none by a model that has seen it.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import binary_list, new_folder, open_store, written

#: Characters of an n-gram; what stands before a text.
ORDER, START = 5, "\x02"
#: Quantile of the trusted documents' bits a unit, by language; a language of fewer than LEAST trusted documents has no threshold.
QUANTILE, LEAST = 0.995, 50
#: Steps to a bit at which the quantiles are read (upwards), so that they need a row for each step and not for each document.
QUANTILE_STEPS = 10_000
#: Parts of the model at least, n-grams to a part; bytes of text that a task counts, and scores, at once; different n-grams that it holds, and passes on at once.
SHARDS, SHARD_GRAMS, COUNTED_CHARS, SCORED_CHARS, HELD_GRAMS, PASSED_GRAMS = 16, 200_000, 400_000, 300_000, 400_000, 50_000
#: Bits of a map, bits for each trusted id in all maps, and probes of a map.
MAP_BITS, BITS_AN_ID, PROBES = 1 << 15, 24, 4
#: Discounts where the counts of counts give none.
PLAIN_DISCOUNTS = (0.5, 1.0, 1.5)

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: What tells n-grams from contexts.
_GRAM, _CONTEXT = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _Q
    return h ^ (h >> np.uint64(29))


def characters(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")


def rolling(c: np.ndarray, most: int) -> list[np.ndarray]:
    """For each length up to ``most``, the hash of the characters that end at each place (those before the first count as 0)."""
    own = _mixed((c.astype(np.uint64) + np.uint64(1)) * _P)
    out = [own]
    for _ in range(most - 1):
        out.append(np.r_[np.uint64(0), out[-1][:-1]] * _P + own)
    return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters after one another, each text after its starts, and which text each place is of (-1: a start)."""
    start = np.full(ORDER - 1, ord(START), np.uint32)
    parts = [x for t in texts for x in (start, characters(t))]
    owners = np.repeat(np.array([v for i in range(len(texts)) for v in (-1, i)], np.int64), [len(p) for p in parts])
    return np.concatenate(parts), owners


class Model:
    """Bits (-log2 p) of seen n-grams and of contexts' back-off weights, in one open-addressed table of hashes."""

    def __init__(self, hashes: np.ndarray, bits: np.ndarray, alphabet: int):
        self.rest = math.log2(alphabet + 1)
        self.shift = np.uint64(64 - max(4, int(2 * len(hashes) + 1).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.bits = np.zeros(size + 1024, np.uint64), np.zeros(size + 1024, np.float32)
        at, left = (hashes >> self.shift).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = hashes[free]  # of several at one place the last stays, the others go on
            self.bits[at[free]] = bits[free]
            left = left[self.keys[at[left]] != hashes[left]]
            at[left] = (at[left] + 1) % len(self.keys)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is in the table, and its bits (0 if not)."""
        at = (h >> self.shift).astype(np.int64)
        seen = self.keys.take(at)
        found, bits = seen == h, self.bits.take(at)
        left = np.flatnonzero(~found & (seen != 0))
        bits[~found] = 0
        while len(left):
            at[left] = (at[left] + 1) % len(self.keys)
            seen = self.keys.take(at[left])
            hit = left[seen == h[left]]
            found[hit], bits[hit] = True, self.bits.take(at[hit])
            left = left[(seen != h[left]) & (seen != 0)]
        return found, bits

    def of_places(self, c: np.ndarray) -> np.ndarray:
        """Bits of each character given those before it; the first ORDER - 1 places are no text."""
        ends = rolling(c, ORDER)
        total, left = np.zeros(len(c), np.float32), np.arange(ORDER - 1, len(c))
        for k in range(ORDER, 0, -1):
            found, bits = self.find(ends[k - 1][left] ^ _GRAM)
            total[left] += bits
            left = left[~found]
            if not len(left):
                return total
            # An unseen context has no weight: the shorter one is asked as it is.
            total[left] += self.find((ends[k - 2][left - 1] if k > 1 else np.zeros(len(left), np.uint64)) ^ _CONTEXT)[1]
        total[left] += np.float32(self.rest)
        return total

    def mean_bits(self, texts: list[bytes]) -> list[float]:
        """Mean bits a character of each text (none is empty)."""
        c, owners = joined(texts)
        bits, inside = self.of_places(c), owners >= 0
        n = np.bincount(owners[inside], minlength=len(texts))
        return (np.bincount(owners[inside], bits[inside].astype(np.float64), len(texts)) / n).tolist()


def trusted_ids(labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Ids of all documents labelled good and not toxic, repeated labels once."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col(id_col).isNotNull())
    return good.select(F.col(id_col).alias("__id")).distinct()


def quota(sizes: list[int], limit: int) -> int:
    """The largest number of documents of each language, one at least, with which all languages together keep to ``limit``."""
    left = limit
    for k, n in enumerate(sorted(sizes)):
        share = left // (len(sizes) - k)
        if n > share:
            return max(1, share)
        left -= n
    return max([1, *sizes])


def fit_sample(trusted: DataFrame, limit: int) -> DataFrame:
    """Ids (``__id``) of about ``limit`` rows of ``trusted`` (__id, lang): by hash, at the same number for each language or half of what it has."""
    sizes = {r["lang"]: r["n"] for r in trusted.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    most, share = quota([-(-n // 2) for n in sizes.values()], limit), F.lit(0.5)
    for lang, n in sizes.items():
        if n > 2 * most:
            share = F.when(F.col("lang").eqNullSafe(F.lit(lang)), F.lit(most / n)).otherwise(share)
    return trusted.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < share * (1 << 30)).select("__id").distinct()


def among(docs: DataFrame, ids: DataFrame, *, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is among ``ids`` (``__id``, all different); they stay where they are, whatever else they hold.

    Bit maps of the ids (a Bloom filter in blocks, three bytes an id) are sent to the rows. The few ids that pass and
    aren't among ``ids`` are found from the ids alone, and sent too.
    """
    maps = max(1, -(-ids.count() * BITS_AN_ID // MAP_BITS))
    of_map = lambda c: F.pmod(F.xxhash64(c), F.lit(maps))
    places = lambda c: [F.shiftrightunsigned(F.xxhash64(c, F.lit(1)), 15 * k).bitwiseAND(F.lit(MAP_BITS - 1).cast("long")) for k in range(PROBES)]
    bits = written(ids.select(of_map("__id").alias("__map"), F.explode(F.array(*places("__id"))).alias("place")).groupBy("__map").agg(F.bitmap_construct_agg("place").alias("__bits")), "maps")

    def passing(rows: DataFrame) -> DataFrame:
        held = F.col(id_col).isNotNull()
        for k in range(PROBES):
            place = f"__place{k}"
            octet = F.conv(F.hex(F.substring("__bits", F.shiftright(place, 3).cast("int") + 1, 1)), 16, 10).cast("int")
            held = held & (F.call_function("shiftright", octet, F.col(place).bitwiseAND(F.lit(7).cast("long")).cast("int")).bitwiseAND(F.lit(1)) == 1)
        keyed = rows.withColumns({"__map": of_map(id_col)} | {f"__place{k}": x for k, x in enumerate(places(id_col))})
        return keyed.join(F.broadcast(bits), "__map").where(held).select(rows.columns)

    wrong = written(passing(docs.select(id_col)).join(ids.withColumnRenamed("__id", id_col), id_col, "left_anti").distinct(), "wrong")
    return passing(docs).join(F.broadcast(wrong), id_col, "left_anti").select(docs.columns)


class _Grams:
    """Different n-grams of texts with their counts, in numpy: a few dozen bytes each, whatever the texts' size."""

    def __init__(self):
        self.texts: list[bytes] = []
        self.size = 0
        self.held: list[tuple[np.ndarray, ...]] = []  # hashes ascending, characters, counts; the first is the sum of earlier ones

    def add(self, text: bytes) -> None:
        self.texts.append(text)
        self.size += len(text)
        if self.size >= COUNTED_CHARS:
            self.count()

    def count(self) -> None:
        if not self.texts:
            return
        c, owners = joined(self.texts)
        self.texts, self.size = [], 0
        ends = np.flatnonzero(owners >= 0)
        hashes, first, n = np.unique(rolling(c, ORDER)[-1][ends], return_index=True, return_counts=True)
        self.held.append((hashes, c[ends[first][:, None] + np.arange(1 - ORDER, 1)], n))
        if sum(len(h) for h, *_ in self.held[1:]) >= max(HELD_GRAMS, len(self.held[0][0])):
            self.merge()

    def merge(self) -> None:
        if len(self.held) > 1:
            hashes, grams, n = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held = []
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            self.held = [(hashes[starts], grams[order[starts]], np.add.reduceat(n[order], starts))]

    def many(self) -> bool:
        return len(self.held) == 1 and len(self.held[0][0]) >= HELD_GRAMS

    def passed(self, part):
        """Record batches of what is held, which is forgotten."""
        import pyarrow as pa

        self.count()
        self.merge()
        for _, grams, n in self.held:
            for a in range(0, len(n), PASSED_GRAMS):
                text, some = grams[a : a + PASSED_GRAMS].astype("<u4").tobytes().decode("utf-32-le", "replace"), n[a : a + PASSED_GRAMS]
                yield pa.RecordBatch.from_arrays([pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)], pa.string()), pa.array(some, pa.int64()), pa.array([part] * len(some), pa.int64())], names=["gram", "n", "part"])
        self.held = []


def gram_counts(docs: DataFrame, *, text_col: str, by: str | None = None) -> DataFrame:
    """gram, n: n-grams of all rows, summed in each task first, then by key; for each whole number in ``by`` apart, if that is given."""

    def run(batches):
        of_part: dict[int, _Grams] = {}
        for batch in batches:
            for text, part in zip(binary_list(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if text:
                    own = of_part.setdefault(part, _Grams())
                    own.add(text)
                    if own.many():
                        yield from own.passed(part)
        for part, own in of_part.items():
            yield from own.passed(part)

    rows = docs.select(text_col, (F.col(by) if by else F.lit(0)).cast("long").alias("part")).where(F.col(text_col).isNotNull())
    return rows.mapInArrow(run, "gram string, n long, part long").groupBy("gram", *(["part"] if by else [])).agg(F.sum("n").alias("n"))


def discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from how many n-grams have counts of 1 to 4; each takes a part of its count, never none or all."""
    if not all(n):
        return list(PLAIN_DISCOUNTS)
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]


def fit(docs: DataFrame, *, text_col: str = "text") -> tuple[np.ndarray, np.ndarray, int]:
    """What a :class:`Model` is made of: hashes, bits, and the number of different characters. Without text it is uniform."""
    folder, alphabet = fit_counts(written(gram_counts(docs, text_col=text_col), "grams"))
    return *stored_model(folder), alphabet


def fit_counts(grams: DataFrame) -> tuple[str, int]:
    """From gram, n of the n-grams of ORDER characters: the folder that the model's shards are written to, and the number of different characters.

    A window over the n-grams of a context has its total and its back-off weight, for all lengths at once. Interpolation
    needs an n-gram's ends only, which have the same last two characters (or one, of which the alphabet's few rows are
    sent along), so it is done where the shard of these is packed.
    """
    spark = grams.sparkSession
    longer = grams.select(F.explode(F.array(*(F.expr(f"right(gram, {k})") for k in range(2, ORDER + 1)))).alias("longer")).distinct()
    shorter = longer.groupBy(F.expr("substring(longer, 2)").alias("gram")).agg(F.count("*").alias("n"))  # how many different characters stand before it
    counts = written(grams.select("gram", "n").unionByName(shorter).withColumn("k", F.char_length("gram")), "grams")
    of_counts: dict[tuple[int, int], int] = {}
    sums: dict[int, int] = {}
    for r in counts.groupBy("k", F.least("n", F.lit(5)).alias("n")).agg(F.count("*").alias("many"), F.sum(counts["n"]).alias("sum")).collect():  # five rows for each length
        of_counts[r["k"], r["n"]] = r["many"]
        sums[r["k"]] = sums.get(r["k"], 0) + r["sum"]
    alphabet = sum(many for (k, _), many in of_counts.items() if k == 1)
    shards = max(SHARDS, -(-sum(of_counts.values()) // SHARD_GRAMS))
    taken = {k: discounts([of_counts.get((k, n), 0) for n in (1, 2, 3, 4)]) for k in range(1, ORDER + 1)}
    of_k = lambda d: F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    own = F.lit(None).cast("double")
    for k, d in taken.items():
        own = F.when(F.col("k") == k, of_k(d)).otherwise(own)
    # Of single characters all is known from the counts of counts.
    weight = sum(many * taken[1][min(n, 3) - 1] for (k, n), many in of_counts.items() if k == 1) / max(1, sums.get(1, 0))
    single = counts.where("k = 1").select(F.col("gram").alias("last"), ((F.col("n") - of_k(taken[1])) / max(1, sums.get(1, 0)) + weight / (alphabet + 1)).alias("of_last"))
    same = Window.partitionBy("context")
    rows = counts.withColumns({"context": F.expr("left(gram, k - 1)"), "last": F.expr("right(gram, 1)"), "own": own})
    total = F.sum("n").over(same)
    rows = rows.select("gram", "k", "last", ((F.col("n") - F.col("own")) / total).alias("part"), (F.sum("own").over(same) / total).alias("weight"), (F.min("gram").over(same) == F.col("gram")).alias("first"))
    rows = rows.join(F.broadcast(single), "last").withColumn("low", F.when(F.col("k") == 1, F.lit(1 / (alphabet + 1))).otherwise(F.col("of_last")))
    shard = F.pmod(F.xxhash64(F.expr("right(gram, 2)")), F.lit(shards)).alias("shard")
    folder = new_folder(spark, "model")
    rows.select(shard, "gram", "k", "part", "weight", "first", "low").groupBy("shard").applyInArrow(_packed, "hashes binary, bits binary").write.parquet(folder)
    return folder, alphabet


def _packed(table):
    """Hashes and bits of one shard's n-grams, and of the contexts whose first n-gram is in it."""
    import pyarrow as pa

    size = table.column("k").to_numpy()
    part, weight, first, low = (table.column(c).to_numpy() for c in ("part", "weight", "first", "low"))
    hashes, values, of_shorter, p = [], [], None, None
    for k in range(1, ORDER + 1):
        at = np.flatnonzero(size == k)
        if not len(at):
            continue
        ends = rolling(np.frombuffer("".join(table.column("gram").take(pa.array(at)).to_pylist()).encode("utf-32-le", "replace"), "<u4"), k)
        lower = low[at] if k < 3 else p[np.searchsorted(of_shorter, ends[k - 2][k - 1 :: k])]
        own, p = ends[k - 1][k - 1 :: k], part[at] + weight[at] * lower
        context = ends[k - 2][k - 2 :: k] if k > 1 else np.zeros(len(at), np.uint64)
        some = first[at].astype(bool)
        hashes += [own ^ _GRAM, context[some] ^ _CONTEXT]
        values += [p, weight[at][some]]
        order = np.argsort(own)
        of_shorter, p = own[order], p[order]
    bits = -np.log2(np.concatenate(values))
    return pa.table({"hashes": pa.array([np.concatenate(hashes).astype("<u8").tobytes()], pa.binary()), "bits": pa.array([bits.astype("<f4").tobytes()], pa.binary())})


def stored_model(folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and bits of all shards, read where they are asked for: 12 bytes a different n-gram or context."""
    import pyarrow as pa
    from pyarrow import dataset

    store, path = open_store(folder)
    rows = dataset.dataset(path, schema=pa.schema({"hashes": pa.binary(), "bits": pa.binary()}), filesystem=store, format="parquet").to_table(use_threads=False)
    return tuple(np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("hashes", "<u8"), ("bits", "<f4")))


_MODELS: dict[str, Model] = {}


def _model(held: tuple[str, int]) -> Model:
    """One model for each worker process."""
    folder, alphabet = held
    if folder not in _MODELS:
        _MODELS.clear()
        _MODELS[folder] = Model(*stored_model(folder), alphabet)
    return _MODELS[folder]


def score(docs: DataFrame, held, *, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``__units`` and ``__bits`` (mean bits a unit; null without text); the text only if asked for."""
    names = [c for c in docs.columns if keep_text or c != text_col]
    source = docs.select(*names, F.col(text_col).alias("__text")) if not keep_text else docs
    text_at = text_col if keep_text else "__text"
    schema = ", ".join([*(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names), "__units long, __bits double"])

    def run(batches):
        import pyarrow as pa

        model = _model(held)
        for batch in batches:
            texts = binary_list(batch.column(text_at))
            mean: list[float | None] = [None] * len(texts)
            some, size = [], 0
            for i, text in [*enumerate(texts), (-1, b"")]:
                if text:
                    some.append(i)
                    size += len(text)
                if some and (size >= SCORED_CHARS or i < 0):
                    for j, bits in zip(some, model.mean_bits([texts[j] for j in some]), strict=True):
                        mean[j] = bits
                    some, size = [], 0
            units = [len(t.decode("utf-8", "replace")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(units, pa.int64()), pa.array(mean, pa.float64())], names=[*names, "__units", "__bits"])

    return source.mapInArrow(run, schema)


def judged(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, trusted_docs: int | None = None, keep_text: bool = False,
) -> DataFrame:
    """All rows of ``docs`` with perplexity, threshold and keep; the text only if asked for.

    A null or empty text has no perplexity and isn't kept. A null language is a language of its own. Repeated rows are
    judged alike, repeated labels count once. A language of fewer than LEAST trusted documents (that the fit leaves) has
    no threshold (it is infinite), and each of its documents with a text is kept. Every perplexity is finite. Columns of
    ``docs`` named like the three new ones are replaced. ``trusted_docs``: where about so many trusted documents are to
    be fitted on, and the others give the quantiles; else all are and do.
    """
    docs = docs.drop("perplexity", "threshold", "keep")
    ids = trusted_ids(labels, id_col=id_col)
    texts = docs.where(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).alias("__id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    if trusted_docs is None:
        own = written(ids.select(F.col("__id").try_cast(docs.schema[id_col].dataType).alias("__id")).where("__id is not null").distinct(), "trusted")
        trusted = among(texts.withColumn("half", F.pmod(F.xxhash64("__id"), F.lit(2))), own, id_col="__id")
        counts = written(gram_counts(trusted, text_col="text", by="half"), "grams")
        others = [fit_counts(counts.where(F.col("part") != h).select("gram", "n")) for h in (0, 1)]
        held = fit_counts(written(counts.groupBy("gram").agg(F.sum("n").alias("n")), "grams"))
        scored = None if keep_text else score(docs, held, text_col=text_col)
        unseen = reduce(DataFrame.unionByName, [score(trusted.where(F.col("half") == h), model) for h, model in enumerate(others)])
    else:
        trusted = written(texts.select("__id", "lang").join(ids, "__id"), "trusted")
        sample = F.broadcast(fit_sample(trusted, trusted_docs))  # about trusted_docs rows
        held = fit_counts(written(gram_counts(texts.join(sample, "__id").select("text"), text_col="text"), "grams"))
        scored = written(score(docs, held, text_col=text_col), "bits")
        unseen = scored.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("lang"), "__bits").join(ids.join(sample, "__id", "left_anti"), "__id")
    steps = unseen.where("__bits is not null").select("lang", F.ceil(F.col("__bits") * QUANTILE_STEPS).alias("step"))
    of_lang = steps.groupBy("lang", "step").agg(F.count("*").alias("n")).groupBy("lang").agg((F.percentile("step", F.lit(quantile), F.col("n")) / QUANTILE_STEPS).alias("q"), F.sum("n").alias("n"))
    limit = F.lit(math.inf)
    for r in of_lang.where(F.col("n") >= LEAST).collect():  # a row for each language
        limit = F.when(F.col(lang_col).eqNullSafe(F.lit(r["lang"])), F.lit(r["q"])).otherwise(limit)
    # The text isn't written a second time: where it is asked for, its documents are scored again.
    out = (score(docs, held, text_col=text_col, keep_text=True) if keep_text else scored).withColumn("__limit", limit)
    return out.withColumns({"perplexity": F.pow(F.lit(2.0), "__bits"), "threshold": F.pow(F.lit(2.0), "__limit"), "keep": F.coalesce(F.col("__bits") <= F.col("__limit"), F.lit(False))}).withColumnRenamed("__units", "n_units").drop("__bits", "__limit")
