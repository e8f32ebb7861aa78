"""Jaccard join of documents on their word n-grams, by vertical partitioning.

The global order of n-grams (64-bit hashes) is cut into fragments. Each fragment finds its repeated n-grams; summed per
document, these partial counts rule out every document of which too little is repeated anywhere. What is left is put in
order of frequency, rarest first: two documents that link share an n-gram of their prefixes, so each such n-gram ties
its documents to one pivot, and documents of one connected set are held against each other. There the overlaps are
again counted fragment by fragment of the order and summed per pair. Only the links of a spanning forest leave a task,
so a group of copies costs rows in proportion to its size. Equal sets are one class throughout.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import ASCII_LOWER, binary_list, written
from siltstone.llm.graph import components

#: Bytes of text to a fragment on average, and fragments at least.
FRAGMENT_BYTES, LEAST_FRAGMENTS = 12 << 20, 64
#: N-grams that a task gathers before it deals them out.
GATHERED = 3_000_000
#: Documents to a block of a connected set, columns of one partial overlap, sets to a group of small ones.
BLOCK, COLUMNS, SMALL_SETS = 1024, 4096, 2048
CACHE_WORDS = 300_000

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _Q
    h = (h ^ (h >> np.uint64(29))) * _P
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted hashes of the different n-grams of words; of fewer words the whole sequence, of none nothing."""
    words = text.translate(ASCII_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * _P + w[i : len(w) - n + 1 + i]
    return np.unique(_mixed(h))


def _dealt(size: int, fragments: int):
    """Of each run of documents: a row for each fragment (hashes, places of the documents), and one about the documents."""

    def run(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        ids, sets, total = [], [], 0

        def rows():
            nonlocal ids, sets, total, serial
            base = part << 32 | serial
            serial += 1
            n = np.array([len(s) for s in sets], np.int64)
            digests = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
            h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            at = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
            fragment = ((h >> np.uint64(44)) * np.uint64(fragments) >> np.uint64(20)).astype(np.int32)
            order = np.argsort(fragment.astype(np.uint16) if fragments < 65536 else fragment, kind="stable")
            low, at, cuts = h[order].astype(np.uint32), at[order], np.searchsorted(fragment[order], np.arange(fragments + 1))
            f = np.flatnonzero(np.diff(cuts))
            out = [(-1 - base, base, np.array(ids, np.int64).tobytes(), n.tobytes(), digests)]
            out += [(int(k), base, low[cuts[k] : cuts[k + 1]].tobytes(), at[cuts[k] : cuts[k + 1]].tobytes(), None) for k in f]
            ids, sets, total = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["fragment", "base", "x", "y", "z"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), binary_list(batch.column(1)), strict=True):
                ids.append(i)
                sets.append(s := shingles(text, size))
                total += len(s)
                if total >= GATHERED or len(ids) == 65_536:
                    yield rows()
        if ids:
            yield rows()

    return run


def _repeated(table):
    """Of one fragment: per run of documents the n-grams that occur in two documents or more, with their frequencies."""
    import pyarrow as pa

    fragment = table.column("fragment")[0].as_py()
    if fragment < 0:
        return table
    xs = [np.frombuffer(x, np.uint32) for x in table.column("x").to_pylist()]
    h = np.concatenate(xs)
    order = np.argsort(h, kind="stable")
    s = h[order]
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    n = np.diff(np.r_[starts, len(s)])
    df = np.empty(len(h), np.uint32)
    df[order] = np.repeat(n, n)
    out, a = {"x": [], "y": [], "z": []}, 0
    for x, y in zip(xs, table.column("y").to_pylist(), strict=True):
        d = df[a : a + len(x)]
        a += len(x)
        keep = d > 1
        out["x"].append(x[keep].tobytes())
        out["y"].append(np.frombuffer(y, np.uint16)[keep].tobytes())
        out["z"].append(np.minimum(d[keep], 65_535).astype(np.uint16).tobytes())
    return pa.table([table.column("fragment"), table.column("base"), *(pa.array(v, pa.binary()) for v in out.values())], names=["fragment", "base", "x", "y", "z"])


def _gathered(percent: int):
    """Of one run of documents: each with its size, digest and, if enough of it is repeated, those n-grams, rarest first."""

    def run(table):
        import pyarrow as pa

        ids = n = digests = None
        parts = []
        for f, x, y, z in zip(*(table.column(c).to_pylist() for c in ("fragment", "x", "y", "z")), strict=True):
            if f < 0:
                ids, n, digests = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), z
            elif x:
                low = np.frombuffer(x, np.uint32).astype(np.uint64)
                parts.append((low | np.uint64(f) << np.uint64(32), np.frombuffer(y, np.uint16), np.frombuffer(z, np.uint16)))
        grams, tokens = [None] * len(ids), len(parts)
        if tokens:
            h, at, df = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((h, df, at))
            h, at = h[order], at[order]
            cuts = np.searchsorted(at, np.arange(len(ids) + 1))
            seen = set()
            for i in np.flatnonzero((100 * np.diff(cuts) >= percent * n) & (n > 0)).tolist():
                if (d := digests[16 * i : 16 * i + 16]) not in seen:  # of equal sets in one run the first is enough
                    seen.add(d)
                    grams[i] = h[cuts[i] : cuts[i + 1]].tobytes()
        d = np.frombuffer(digests, np.int64).reshape(-1, 2)
        return pa.table([pa.array(ids), pa.array(n), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(grams, pa.binary())], names=["doc_id", "n", "d1", "d2", "grams"])

    return run


def _prefixes(percent: int):
    """gram, spare (unrepeated share in thousandths), class_id of the n-grams among which linking documents share one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            gram, spare, own = [], [], []
            for c, n, g in zip(*(batch.column(k).to_pylist() for k in ("class_id", "n", "grams")), strict=True):
                h = np.frombuffer(g, np.int64)
                h = h[: len(h) - -(-percent * n // 100) + 1]
                gram.append(h)
                spare.append(np.full(len(h), 1000 * (n - len(g) // 8) // n, np.int64))
                own.append(np.full(len(h), c, np.int64))
            if gram:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (gram, spare, own)], names=["gram", "spare", "class_id"])

    return run


def linked(grams: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets link: partial overlaps per fragment of the order, summed per pair."""
    m = len(grams)
    codes, at = np.unique(np.concatenate(grams), return_inverse=True)
    row = np.repeat(np.arange(m), [len(g) for g in grams])
    keep = np.bincount(at, minlength=len(codes)) > 1  # an n-gram of one set adds nothing
    new = np.cumsum(keep) - 1
    row, at = row[keep[at]], new[at[keep[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    overlap = np.zeros((m, m), np.float32)
    for a in range(0, int(keep.sum()), COLUMNS):
        lo, hi = np.searchsorted(at, [a, a + COLUMNS])
        part = np.zeros((m, min(COLUMNS, int(keep.sum()) - a)), np.float32)
        part[row[lo:hi], at[lo:hi] - a] = 1
        overlap += part @ part.T
    both = overlap.astype(np.int64)
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of a symmetric matrix."""
    left, out = np.ones(len(near), bool), []
    for i in range(len(near)):
        if not left[i]:
            continue
        left[i], stack = False, [i]
        while stack:
            k = stack.pop()
            for j in np.flatnonzero(near[k] & left).tolist():
                left[j] = False
                out.append((k, j))
                stack.append(j)
    return out


def _links(percent: int):
    def run(table):
        import pyarrow as pa

        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(table.column(k).to_pylist() for k in ("component", "p", "q")), strict=True)):
            groups.setdefault(key, []).append(i)
        ids, n, grams = table.column("class_id").to_numpy(), table.column("n").to_numpy(), table.column("grams")
        out = []
        for rows in groups.values():
            near = linked([np.frombuffer(grams[i].as_buffer(), np.uint64) for i in rows], n[rows], percent)
            out += [(int(ids[rows[a]]), int(ids[rows[b]])) for a, b in forest(near)]
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return run


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id for every row with an id.

    Two documents link if 100 * intersection >= ``percent`` * union of their sets of different ``size``-word n-grams;
    component_id is the smallest id reachable by links. A document of fewer words has its whole sequence as its one
    n-gram; one without words or text has none and links with nothing. Rows of a null id are left out; rows that share
    an id keep a row each. An empty table gives no row. Ids are integers.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    octets = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(LEAST_FRAGMENTS, int(octets) // FRAGMENT_BYTES)
    blobs = "fragment long, base long, x binary, y binary, z binary"
    repeated = source.mapInArrow(_dealt(size, fragments), blobs).groupBy("fragment").applyInArrow(_repeated, blobs)
    sets = written(repeated.groupBy("base").applyInArrow(_gathered(percent), "doc_id long, n long, d1 long, d2 long, grams binary"), "sets")

    classes = written(sets.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"), F.max("n").alias("n"), F.max("grams").alias("grams")).where("grams is not null"), "classes")
    prefixes = written(classes.select("class_id", "n", "grams").mapInArrow(_prefixes(percent), "gram long, spare long, class_id long"), "prefixes")
    pivots = prefixes.groupBy("gram").agg(F.min(F.struct("spare", "class_id")).alias("pivot"), F.count("*").alias("many")).where("many > 1").select("gram", F.col("pivot.class_id").alias("a"))
    connected = components(prefixes.join(pivots, "gram").select("a", F.col("class_id").alias("b")).where("a <> b").distinct())

    sizes = connected.groupBy("component").agg(F.count("*").alias("many"))
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    placed = classes.join(connected, F.col("class_id") == F.col("node")).join(sizes, "component").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = max(64, placed.count() // SMALL_SETS)
    placed = placed.select(
        "component", "class_id", "n", "grams", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
        F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(F.abs(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")) / 2).cast("long")).alias("task"),
    )
    found = components(placed.groupBy("task").applyInArrow(_links(percent), "a long, b long"))

    of_class = sets.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("many"))
    named = of_class.join(found, F.col("class_id") == F.col("node"), "left").select("d1", "d2", F.coalesce("component", "class_id").alias("component_id"), "many", "component").where("many > 1 or component is not null")
    return sets.select("doc_id", "n", "d1", "d2").join(named.select("d1", "d2", "component_id"), ["d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
