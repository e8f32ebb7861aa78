"""Phrases whose words go together: counts of n-grams by hash bucket, scores by lookups of the parts.

Texts are cut into pieces at punctuation; equal pieces of a language become one with a multiplicity. Different pieces are
dealt to buckets of a bounded size. Each bucket counts the n-grams of its pieces, weighted by multiplicity, and sends
them to the hash buckets of n-grams, where DuckDB adds them up (it spills beyond its memory) and answers every bucket
that asked with a list of the n-grams that are frequent. As no phrase is more frequent than its parts, the next n-grams
are counted only where all their parts are frequent: words, then pairs, then longer phrases. No table of n-grams is in
one place.

A phrase's score needs the counts of its parts: each candidate sends a request for every part to where that is counted,
and the answers meet again at the candidate.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import binary_list, written

#: What ends a piece, in ASCII bytes.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Lower-cases A-Z and makes every end a line feed.
PIECES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in ENDS else b for b in range(256))
#: Words of a phrase at most, occurrences at least, phrases of a language in the result at most.
LONGEST, LEAST, FIRST = 5, 100, 2000
#: Different pieces that a task gathers before it passes them on; bytes of pieces to a bucket.
GATHERED, BUCKET_BYTES = 500_000, 12 << 20
#: Memory of a count, beyond which DuckDB spills to its task's folder; parts that are single words are asked for in so many places.
COUNT_MEMORY, SALTS = "384MB", 16
NO_LANGUAGE = "und"


def pieces(docs: DataFrame, *, text_col: str, lang_col: str) -> DataFrame:
    """lang, piece, m: the different pieces of a language, their words joined by single spaces, and how often each occurs."""

    def run(batches):
        import pyarrow as pa

        def batch_of(counts):
            keys = list(counts)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang for lang, _ in keys], pa.string()), pa.array([p for _, p in keys], pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "piece", "m"]
            )

        counts: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), binary_list(batch.column(1)), strict=True):
                if text:
                    counts.update((lang, b" ".join(words)) for words in map(bytes.split, text.translate(PIECES).split(b"\n")) if words)
                if len(counts) >= GATHERED:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE))
    found = docs.select(lang.alias("lang"), F.col(text_col)).mapInArrow(run, "lang string, piece string, m long")
    return found.groupBy("lang", "piece").agg(F.sum("m").alias("m"))


class Words:
    """The words of one bucket's pieces as numbers, and which n-grams of them are asked about."""

    def __init__(self, table):
        import numpy as np
        import pyarrow.compute as pc

        split = pc.split_pattern(table["piece"].combine_chunks(), " ")
        self.parent = pc.list_parent_indices(split).to_numpy()
        coded = pc.list_flatten(split).dictionary_encode()
        self.names, self.ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.weight = table["m"].to_numpy()[self.parent]

    def inside(self, n: int):
        """The places where an n-gram begins that ends within its piece."""
        import numpy as np

        return np.flatnonzero(self.parent[: len(self.ids) - n + 1] == self.parent[n - 1 :]) if len(self.ids) >= n else np.zeros(0, np.int64)

    def known(self, phrases, n: int):
        """For each place whether the n-gram that begins there (n is 1 or 2) is among ``phrases``."""
        import numpy as np
        import pyarrow.compute as pc

        out, at, many = np.zeros(len(self.ids), bool), self.inside(n), len(self.names)
        if len(phrases):
            split = pc.split_pattern(phrases, " ")
            parts = [pc.fill_null(pc.index_in(pc.list_element(split, k), self.names), -1).to_numpy().astype(np.int64) for k in range(n)]
            here = np.all([x >= 0 for x in parts], axis=0)
            code = lambda xs: xs[0] if n == 1 else xs[0] * many + xs[1]
            out[at] = np.isin(code([self.ids[at + k] for k in range(n)]), code(parts)[here])
        return out

    def counted(self, n: int, at):
        """(phrases, weights) of the different n-grams that begin at the places ``at``."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        code = self.ids[at]
        for k in range(1, n):  # numbered anew with each word, so that a number stays below (places) x (words)
            code = np.unique(code, return_inverse=True)[1] * len(self.names) + self.ids[at + k]
        _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        words = [self.names.take(pa.array(self.ids[at[first] + k])) for k in range(n)]
        totals = np.zeros(len(first), np.int64)
        np.add.at(totals, inverse, self.weight[at])
        return pc.binary_join_element_wise(*words, " ") if n > 1 else words[0], pa.array(totals)


def partial(dealt: DataFrame, sizes: range, answers: DataFrame | None) -> DataFrame:
    """lang, bucket, phrase, m of the n-grams of ``sizes`` in each bucket; with ``answers`` those whose parts of one word less, or
    of two words, are all frequent.
    """
    schema = "lang string, bucket long, phrase string, m long"

    def run(left, right=None):
        import numpy as np
        import pyarrow as pa

        out = []
        if left.num_rows:
            words, lang, bucket = Words(left), left["lang"][0].as_py(), left["bucket"][0].as_py()
            step = min(sizes[0] - 1, 2)
            ok = None if right is None else words.known(right["phrases"].combine_chunks().flatten(), step)
            for n in sizes:
                at = words.inside(n)
                for k in range(n - step + 1 if ok is not None else 0):
                    at = at[ok[at + k]]
                if len(at):
                    phrase, m = words.counted(n, at)
                    out.append(pa.table([pa.array([lang] * len(m), pa.string()), pa.array(np.full(len(m), bucket)), phrase, m], names=["lang", "bucket", "phrase", "m"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.int64())], names=["lang", "bucket", "phrase", "m"])

    if answers is None:
        return dealt.groupBy("lang", "bucket").applyInArrow(lambda table: run(table), schema)
    return dealt.groupBy("lang", "bucket").cogroup(answers.groupBy("lang", "bucket")).applyInArrow(lambda left, right: run(left, right), schema)


def counted(parts: DataFrame, least: int, answered: int = 0) -> DataFrame:
    """lang, phrase, total of the phrases that occur ``least`` times or more over all buckets; then lang, bucket, phrases:
    those of ``answered`` words among them that a bucket has, as one list. A task holds one hash bucket of phrases, in DuckDB.
    """
    frequent = f"create table frequent as select lang, phrase, sum(m)::bigint as total from parts group by all having sum(m) >= {least}"
    totals = "select lang, phrase, total, null::bigint as bucket, null::varchar[] as phrases from frequent"
    answers = f"select lang, null::varchar as phrase, null::bigint as total, bucket, list(phrase) as phrases from parts join frequent using (lang, phrase) where len(string_split(phrase, ' ')) = {answered} group by lang, bucket"

    def run(batches):
        import tempfile

        import duckdb
        import pyarrow as pa

        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": COUNT_MEMORY, "temp_directory": spill}) as db:
            db.execute("create table parts (lang varchar, bucket bigint, phrase varchar, m bigint)")
            for batch in batches:
                db.register("batch", pa.Table.from_batches([batch]))
                db.execute("insert into parts select * from batch")
                db.unregister("batch")
            db.execute(frequent)
            for query in (totals, answers) if answered else (totals,):
                yield from db.sql(query).to_arrow_reader(10_000)

    return parts.repartition("lang", "phrase").mapInArrow(run, "lang string, phrase string, total long, bucket long, phrases array<string>")


def frequent_phrases(found: DataFrame, sizes: DataFrame, *, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, phrase, total of all phrases of up to ``longest`` words with at least ``least`` occurrences; found: lang, piece, m; sizes: lang, buckets."""
    dealt = found.join(sizes.select("lang", "buckets"), "lang").select("lang", F.pmod(F.xxhash64("piece"), F.col("buckets")).alias("bucket"), "piece", "m")
    answers, out = None, []
    for n in [range(1, 2), range(2, 3), range(3, longest + 1)][: min(longest, 3)]:
        step = written(counted(partial(dealt, n, answers), least, n[0] if n[-1] < longest else 0), "frequent")
        answers = step.where("phrases is not null").select("lang", "bucket", "phrases")
        out.append(step.where("phrase is not null").select("lang", "phrase", "total"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate by its lowest cut, without those that a longer one covers.

    counts: lang, phrase, total of all frequent phrases, words included; totals: lang, n. A candidate asks for both parts
    of each cut; a part of one word, which many may ask for, is kept in SALTS places.
    """
    words = F.split("phrase", " ")
    salt = F.when(F.size("words") == 1, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(0)
    candidates = counts.select("lang", "phrase", F.col("total").alias("a"), words.alias("words")).where(F.size("words") > 1)
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.slice("words", 1, F.col("k")).alias("words")), F.struct(F.lit(1).alias("side"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("words")))
    asks = cuts.select("lang", "phrase", "a", "k", F.size("words").alias("long"), F.explode(sides).alias("x")).select("lang", "phrase", "a", "k", "long", "x.side", F.col("x.words").alias("words"))
    asks = asks.select("lang", "phrase", "a", "k", "long", "side", F.array_join("words", " ").alias("part"), salt.alias("salt"))
    kept = counts.select("lang", F.col("phrase").alias("part"), "total", F.explode(F.when(F.size(words) == 1, F.expr(f"sequence(0L, {SALTS - 1}L)")).otherwise(F.expr("array(0L)"))).alias("salt"))
    answers = written(asks.join(kept, ["lang", "part", "salt"]), "answers")
    # A phrase inside a longer one as frequent as itself is inside one with one word more as frequent, as its first or its last words.
    ends = (F.col("side") == 1) & (F.col("k") == 1) | (F.col("side") == 0) & (F.col("k") == F.col("long") - 1)
    covered = answers.where(ends & (F.col("long") > 2) & (F.col("total") == F.col("a"))).select("lang", F.col("part").alias("phrase")).distinct()
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("total")))
    by_cut = answers.repartition("lang", "phrase").groupBy("lang", "phrase", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    with_n = by_cut.join(totals.select("lang", "n"), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * F.col("n").cast("decimal(15,0)"), wide("l") * wide("r"))
    best = with_n.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.join(covered, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def mined(docs: DataFrame, *, longest: int = LONGEST, least: int = LEAST, first: int = FIRST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` best phrases of each language.

    A null language is ``und``; null and empty texts and pieces without words count nothing. Repeated rows count again.
    Ties of a score go by occurrences, then by the phrase's bytes. A language without a candidate has no row, and neither
    has an empty table.
    """
    found = written(pieces(docs, text_col=text_col, lang_col=lang_col), "pieces")
    in_words = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    per_bucket = F.greatest(F.lit(1), F.ceil(F.sum(F.octet_length("piece")) / BUCKET_BYTES))
    totals = written(found.groupBy("lang").agg(F.sum(in_words * F.col("m")).alias("n"), per_bucket.alias("buckets")), "totals")
    counts = frequent_phrases(found, totals, longest=longest, least=least)
    ranked = scored(counts, totals)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # First within parts of a language, so that no task sorts all of its candidates.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = ranked.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return top.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in SQL, which counts all n-grams as strings.
SQL = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\n-\r]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^ \t]+') as ws from p),
totals as (select lang, sum(len(ws))::bigint as n from w group by lang),
g as (select lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i : i + size - 1], ' '))) as phrase from w, (select unnest(range(1, 6)) as size) where len(ws) >= size),
f as (select lang, size, phrase, count(*) as c from g group by all having count(*) >= 100),
cuts as (select lang, phrase, size, c as a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') as head, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') as rest from f, (select unnest(range(1, 5)) as k) where size > 1 and k < size),
met as (select cuts.lang, cuts.phrase, a, k, x.c as l, y.c as r, n, 1000::hugeint * a * n // (x.c::hugeint * y.c) as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = head join f y on y.lang = cuts.lang and y.phrase = rest join totals on totals.lang = cuts.lang),
best as (select * from met qualify row_number() over (partition by lang, phrase order by score, k) = 1),
kept as (select * from best b where not exists (select 1 from f where f.lang = b.lang and f.size > len(string_split(b.phrase, ' ')) and f.c >= b.a and contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
select lang, (row_number() over (partition by lang order by score desc, a desc, phrase))::int as rank, phrase, a, l, r, n, score::bigint as score from kept qualify rank <= 2000
"""
