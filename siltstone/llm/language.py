"""Language identification by rank-order profiles.

A language's profile is the ranking of its most frequent character n-grams (one to three letters, words padded with
``_``). A document's own ranking is held against each profile: an n-gram counts the difference of its two ranks, or the
profile's length if the profile lacks it; the language with the smallest sum is the prediction.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import binary_list

#: N-grams in a profile and of a document.
PROFILE = 300
#: Characters of a language that a task counts at once.
COUNTED_CHARS = 4_000_000
#: Groups by which the n-grams of a language are dealt when its profile is cut.
SALTS = 64

_PAD = ord("_")


def _letters() -> np.ndarray:
    """Which of the first 65,536 characters are letters."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


_LETTERS: list[np.ndarray] = []


def grams(text: bytes | None) -> np.ndarray:
    """All n-grams of a text as numbers: 21 bits a character, the last one lowest; empty without letters.

    Anything but letters parts words; a pair has a letter, and three have one in the middle.
    """
    if not text:
        return np.empty(0, np.int64)
    if not _LETTERS:
        _LETTERS.append(_letters())
    c = np.frombuffer(f" {text.decode('utf-8', 'replace').lower()} ".encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    letter = _LETTERS[0].take(np.minimum(c, 0xFFFF))
    if (far := np.flatnonzero(c > 0xFFFF)).size:
        letter[far] = [chr(x).isalpha() for x in c[far].tolist()]
    c = np.where(letter, c, _PAD)
    two = c[:-1] << 21 | c[1:]
    return np.concatenate([c[letter], two[letter[:-1] | letter[1:]], (two[:-1] << 21 | c[2:])[letter[1:-1]]])


def gram_text(code: int) -> str:
    """The n-gram of a number."""
    return "".join(chr(c) for c in (code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF) if c)


def count_grams(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (ascending) and counts of the n-grams of a text."""
    return np.unique(grams(text), return_counts=True)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def ranking(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent of ascending n-grams, best first; of equal counts the smaller number."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


def gram_counts(docs: DataFrame, *, text_col: str, lang_col: str) -> DataFrame:
    """lang, gram, n over all rows with a language: summed in each task first, then by key."""

    def run(batches):
        import pyarrow as pa

        waiting: dict[str, list[bytes]] = {}
        chars: dict[str, int] = {}
        totals: dict[str, list] = {}

        def count(lang: str) -> None:
            part = count_grams(b"\n".join(waiting.pop(lang)))
            totals[lang] = [_added([*totals.get(lang, []), part])]
            chars[lang] = 0

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), binary_list(batch.column(1)), strict=True):
                waiting.setdefault(lang, []).append(text)
                chars[lang] = chars.get(lang, 0) + len(text)
                if chars[lang] >= COUNTED_CHARS:
                    count(lang)
        for lang in list(waiting):
            count(lang)
        for lang, ((codes, n),) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"])

    counted = docs.select(lang_col, text_col).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return counted.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    """A ranking for each language, from all rows of ``docs`` that have a language and a text.

    What comes to the driver is at most SALTS * ``size`` n-grams a language.
    """
    salted = gram_counts(docs, text_col=text_col, lang_col=lang_col).groupBy("lang", F.pmod(F.xxhash64("gram"), F.lit(SALTS)).alias("salt"))
    best = salted.agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram"))), 1, size).alias("best"))
    found: dict[str, list] = {}
    for row in best.collect():
        found.setdefault(row["lang"], []).extend((x["n"], x["gram"]) for x in row["best"])
    return {lang: np.array([g for _, g in sorted(rows)[:size]], np.int64) for lang, rows in sorted(found.items()) if rows}


class Matcher:
    """Holds rankings against all profiles at once."""

    def __init__(self, by_lang: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(by_lang), size
        self.grams = np.unique(np.concatenate([np.empty(0, np.int64), *by_lang.values()]))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)  # the last row: an n-gram of no profile
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, by_lang[lang]), j] = np.arange(len(by_lang[lang]))

    def predict(self, text: bytes | None) -> tuple[str, float]:
        codes, counts = count_grams(text)
        if not len(codes) or not self.langs:
            return "und", 0.0
        own = ranking(codes, counts, self.size)
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == own, at, len(self.grams))
        ranks = self.ranks[at]
        distance = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(0)
        k = int(distance.argmin())  # of equal distances the first language by name
        return self.langs[k], float(1 - distance[k] / (self.size * len(own)))


def identify(docs: DataFrame, by_lang: dict[str, np.ndarray], *, text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """``docs`` without its text, with lang_pred and score (1: ranked as the profile; 0: nothing in common).

    A text that is null, empty or without letters gives ``und`` and 0, as does any text if there are no profiles. Of
    languages at equal distance the first by name is taken. All other columns go through unless they bear the names of
    the new ones, which replace them.
    """
    others = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    source = docs.select(*others, F.col(text_col).alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"), "lang_pred string, score double"])

    def run(batches):
        import pyarrow as pa

        matcher = Matcher(by_lang, size)
        for batch in batches:
            found = [matcher.predict(t) for t in binary_list(batch.column("__text"))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*others, "lang_pred", "score"],
            )

    return source.mapInArrow(run, schema)
