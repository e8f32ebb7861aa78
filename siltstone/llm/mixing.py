"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its words and one end. A word of the vocabulary (the most frequent words of the training text) is one symbol;
any other is an escape symbol and then its bytes and an end of word. Symbols have Huffman codes, and each bit of a code
is predicted given the bits before it by three predictors, each from counts under a hashed context:

    words: none | the word before | the last very frequent word (mostly the language)
    bytes: one byte before | two | one and the last very frequent word

Their counts are gathered over all training text outside a small fold, in tables whose size follows the text up to a
bound. A mixer adds the predictors' log-odds with weights from a set that is chosen by the kind of symbol and by how
sure two predictors are; the weights are learned bit after bit on the fold that the counts haven't seen, in shards by
hash of the document, and an adaptive map, learned there too, refines the mixed probability.

Longer contexts grow with the text without bound, so they stay in shards: every token goes, as its symbol with the
symbol's mixed probability, to the shard of the two words before it. There all training tokens of a context are counted
(a training document's own ones are left out for itself), and the shares of the symbols that followed the context are
mixed in with a weight that depends on how often the context was seen and is learned in the shard. Shares and mixed
probabilities of the symbols sum to one each, and so does their mixture; a spelled word is its escape symbol times its
bytes. All of it multiplies to a text's probability, whatever the input's partitions are.
"""

from __future__ import annotations

import heapq
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import binary_list, crc_fold, written

#: Words with a code of their own, slots of a table at least and at most (as powers of two), very frequent words.
VOCABULARY, LEAST_BITS, MOST_BITS, MARKERS = (1 << 17) - 2, 18, 21, 64
#: Tokens to a shard of contexts, and shards at least; tokens that a task gathers before it deals them out; bytes of text that weights are learned on in one go.
SHARD_TOKENS, LEAST_SHARDS, RUN_TOKENS, LEARNED_BYTES = 1_000_000, 32, 2_000_000, 8 << 20
#: Kinds of contexts by how often they were seen (powers of two), rounds in which their weights settle, units of a log10 probability.
SEEN_KINDS, ROUNDS, UNIT = 8, 6, 0.03
#: A token on its way: 22 bits of context, 17 of its symbol (of the vocabulary, the escape and the end) and 9 of the symbol's probability, in six bytes.
TOKEN_BYTES, SYMBOL_BITS, PLAIN_BITS = 6, 17, 9
#: Slots to a piece of a table when tables are added up, and tasks whose pieces are added up at once.
PIECE, ADDED = 1 << 14, 256
CONTEXTS, CONFIDENCE = 3, 3
GATES, STEPS = 2 * CONFIDENCE**2, 33
#: Tokens whose bits are worked on at once, different words that a task counts before it passes them on.
CHUNK_TOKENS, COUNTED_WORDS = 16_000, 400_000
#: Spelled letters, and tokens, that a task gathers before it adds them to its tables; tokens among which equal ones are scored once.
COUNTED_LETTERS, COUNTED_TOKENS, WINDOW_TOKENS = 1_500_000, 2_000_000, 64_000
#: Unknown words among which equal letters are scored once; bytes of text that are split at once.
SPELLED_WORDS, SPLIT_BYTES = 16_000, 4 << 20
#: A stored log-odds unit, and the prior of a count.
SCALE, PRIOR = 15.0, 0.4
END_OF_WORD = 256


def split_words(texts):
    """How many words each text of an Arrow column has (null: none), and all the words, A-Z lower-cased."""
    import pyarrow as pa
    import pyarrow.compute as pc

    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.view(pa.large_string() if wide else pa.string()), "")))
    many, words = pc.list_value_length(parts).to_numpy().astype(np.int64), parts.flatten()
    empty = pc.binary_length(words).to_numpy() == 0  # before the first word, after the last, of texts without any
    if empty.any():
        many -= np.bincount(np.repeat(np.arange(len(many)), many)[empty], minlength=len(many))
        words = words.filter(pa.array(~empty))
    return many, words.view(pa.large_binary() if wide else pa.binary())


def split_pieces(batches, column: int, most: int = SPLIT_BYTES):
    """Batch, the place of the first row, how many words and which, for runs of rows of about ``most`` bytes."""
    import pyarrow.compute as pc

    for batch in batches:
        texts = batch.column(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            yield batch, a, *split_words(texts.slice(a, b - a))
            a = b


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and canonical codes; counts are raised to a floor that keeps a code within 31 bits."""
    counts = np.maximum(np.asarray(counts, np.float64), max(1.0, float(np.sum(counts)) / (1 << 22)))
    if len(counts) == 1:
        return np.ones(1, np.uint8), np.zeros(1, np.uint32)
    n, parent = len(counts), np.zeros(2 * len(counts) - 1, np.int64)
    heap = [(c, i) for i, c in enumerate(counts.tolist())]
    heapq.heapify(heap)
    for k in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = k
        heapq.heappush(heap, (a + b, k))
    depth = np.zeros(2 * n - 1, np.int64)
    for i in range(2 * n - 3, -1, -1):
        depth[i] = depth[parent[i]] + 1
    lengths = depth[:n].astype(np.uint8)
    codes, code, last = np.zeros(n, np.uint32), 0, 0
    for i in np.lexsort((np.arange(n), lengths)).tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return lengths, codes


def _hash(*parts) -> np.ndarray:
    h = np.full(1, 0x9E3779B9, np.uint32)
    for p in parts:
        h = (h ^ np.asarray(p, np.uint32)) * np.uint32(0x85EBCA6B)
        h = h ^ (h >> np.uint32(15))
    return h


_ALONE = _hash(np.ones(1, np.uint32))[0]


def _order(own: np.ndarray, bits: int) -> np.ndarray:
    """Places in ascending order of numbers of ``bits`` bits, equal ones as they come: plain numbers are sorted much faster than places."""
    width = len(own).bit_length()
    if bits + width > 64:
        return np.argsort(own, kind="stable")
    both = own << np.uint64(width) | np.arange(len(own), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << width) - 1)).astype(np.int64)


def _alike(order: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each number, and which of them each is like; ``order`` brings equal ones together."""
    fresh, there, like = np.ones(len(own), bool), own[order], np.empty(len(own), np.int64)
    fresh[1:] = there[1:] != there[:-1]
    like[order] = np.cumsum(fresh) - 1
    return order[fresh], like


class Words:
    """Words of documents: how many each has, and each word as its place among the different ones."""

    def __init__(self, many: np.ndarray, at: np.ndarray, different, symbols: np.ndarray):
        self.many, self.at, self.different, self.symbols = many, at, different, symbols

    @classmethod
    def of(cls, many: np.ndarray, words, coder: Coder) -> Words:
        own = words.dictionary_encode()
        return cls(many, own.indices.to_numpy(), own.dictionary, coder.symbols_of(own.dictionary))

    def chunks(self, tokens: int):
        """The first document's place, and the words of documents from there on, about ``tokens`` tokens at once."""
        ends, ends_words, a = np.cumsum(self.many + 1), np.r_[0, np.cumsum(self.many)], 0
        while a < len(ends):
            b = min(len(ends), int(np.searchsorted(ends, (ends[a - 1] if a else 0) + tokens)) + 1)
            yield a, Words(self.many[a:b], self.at[ends_words[a] : ends_words[b]], self.different, self.symbols)
            a = b

    def octets(self) -> np.ndarray:
        """Bytes of each document's words, with one after each."""
        import pyarrow.compute as pc

        lengths = pc.binary_length(self.different).to_numpy().astype(np.int64) + 1
        return np.bincount(np.repeat(np.arange(len(self.many)), self.many), lengths[self.at], len(self.many)).astype(np.int64)

    def spelled(self, at: np.ndarray) -> list[bytes]:
        import pyarrow as pa

        return self.different.take(pa.array(at)).to_numpy(zero_copy_only=False).tolist()


class Coder:
    """Turns documents into bits with contexts. ``counted``: the vocabulary's words with counts, most frequent first."""

    def __init__(self, counted: list[tuple[bytes, int]], tokens: int, ends: int, table_bits: int):
        import pyarrow as pa

        self.table_bits = table_bits
        self.words = pa.array([w for w, _ in counted], pa.binary())
        own = np.array([n for _, n in counted], np.float64)
        self.escape, self.end = len(counted), len(counted) + 1
        self.log_counts = np.log10(np.r_[own, 0, ends] + 1)
        self.lengths, self.codes = huffman(np.r_[own, max(1, tokens - ends - own.sum()), max(1, ends)])
        of_bytes = np.ones(257)
        for w, n in counted:
            np.add.at(of_bytes, np.frombuffer(w, np.uint8), n)
            of_bytes[END_OF_WORD] += n
        self.byte_lengths, self.byte_codes = huffman(of_bytes)

    @staticmethod
    def _bits(symbols, lengths, codes):
        """How many bits each symbol has, and for each bit its node in the code tree and its value."""
        own = lengths[symbols]
        n = own.astype(np.int64)
        ends = np.cumsum(n)
        rest = np.repeat(ends.astype(np.uint32), n) - np.arange(n.sum(), dtype=np.uint32)  # bits to come, this one included
        code = np.repeat(codes[symbols], n)
        prefix = code >> rest
        return n, (np.uint32(1) << (np.repeat(own, n).astype(np.uint32) - rest)) | prefix, (code >> (rest - np.uint32(1))) & np.uint32(1)

    def symbols_of(self, words) -> np.ndarray:
        """Of an Arrow array of words; the escape for any unknown one."""
        import pyarrow.compute as pc

        return pc.fill_null(pc.index_in(words, self.words.cast(words.type)), self.escape).to_numpy().astype(np.int64)

    def tokens(self, docs: Words | list[list[bytes]]):
        """The documents' sizes, the tokens' symbols, the word before each, the last very frequent word and the context of two words (64 bits); the places of unknown words, and they."""
        import pyarrow as pa

        if isinstance(docs, list):
            docs = Words.of(np.array([len(d) for d in docs], np.int64), pa.array(chain.from_iterable(docs), pa.binary()), self)
        escape, sizes = self.escape, docs.many + 1
        symbols = np.full(sizes.sum(), self.end, np.int64)
        ends = np.cumsum(sizes) - 1
        inner = np.ones(len(symbols), bool)
        inner[ends] = False
        symbols[inner] = docs.symbols[docs.at]
        starts = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(sizes)), sizes)
        rare_at = np.flatnonzero(symbols == escape)
        rare = docs.spelled(docs.at[rare_at - doc[rare_at]])  # each document before has an end
        # What a token is as a context: its number, or a hash of an unknown word.
        own = symbols.astype(np.uint32)
        if len(rare):
            letters, spans = self._letters(rare)
            first = np.cumsum(spans) - spans
            powers = np.uint32(31) ** (np.arange(len(letters)) - np.repeat(first, spans)).astype(np.uint32)
            own[rare_at] = np.add.reduceat(_hash(letters) * powers, first) | np.uint32(1 << 31)
        at = np.arange(len(symbols))
        begin = starts[doc]
        before = np.where(at - 1 >= begin, np.roll(own, 1), np.uint32(0xFFFFFFFF))
        before2 = np.where(at - 2 >= begin, np.roll(own, 2), np.uint32(0xFFFFFFFF))
        seen = np.maximum.accumulate(np.where(symbols < MARKERS, at, -1))
        seen = np.r_[-1, seen[:-1]]
        marker = np.where(seen >= begin, own[seen], np.uint32(0xFFFFFFFF))
        two = _hash(9, before, before2).astype(np.uint64) << np.uint64(32) | _hash(10, before2, before)
        return sizes, symbols, before, marker, two, rare_at, rare

    @staticmethod
    def _letters(words: list[bytes]):
        return np.frombuffer(b"".join(words), np.uint8).astype(np.int64), np.array([len(w) for w in words], np.int64)

    def symbol_bits(self, symbols, before, marker):
        """For each bit of the symbols: the slots in the tables (one row each), the bit; how many bits each symbol has."""
        n, node, bit = self._bits(symbols, self.lengths, self.codes)
        return self._slots([None, _hash(2, before), _hash(4, marker)], n, node), bit, n

    def letters(self, words: list[bytes], marker):
        """Letters of words that are spelled, with an end after each word: they, the one and two before each (257: none), the last very frequent word; how many each word has."""
        own, spans = self._letters(words)
        n = spans + 1
        ends = np.cumsum(n)
        stream, inner = np.full(ends[-1] if len(n) else 0, END_OF_WORD, np.uint32), np.ones(ends[-1] if len(n) else 0, bool)
        inner[ends - 1] = False
        stream[inner] = own
        back, back2 = np.roll(stream, 1), np.roll(stream, 2)
        back[ends - n] = back2[ends - n] = 257
        back2[(ends - n + 1)[n > 1]] = 257
        return stream, back, back2, np.repeat(marker.astype(np.uint32), n), n

    def letter_bits(self, stream, back, back2, marker):
        """The same as for symbols."""
        n, node, bit = self._bits(stream, self.byte_lengths, self.byte_codes)
        return self._slots([_hash(5, back), _hash(6, back, back2), _hash(8, back, marker)], n, node), bit, n

    def byte_bits(self, words: list[bytes], marker):
        """The same for words that are spelled; how many bits each word has."""
        *letters, n = self.letters(words, marker)
        slots, bit, many = self.letter_bits(*letters)
        return slots, bit, np.bincount(np.repeat(np.arange(len(n)), n), many, len(n)).astype(np.int64)

    def events(self, docs: Words | list[list[bytes]]):
        """For each bit: the slots in the tables (one row each), the bit, the kind (0 word, 1 byte) and the token.

        Then the documents' sizes, the tokens' symbols and contexts of two words (64 bits), and the unknown words.
        """
        sizes, symbols, before, marker, two, rare_at, rare = self.tokens(docs)
        parts = [(*self.symbol_bits(symbols, before, marker), np.arange(len(symbols)))]
        if len(rare):
            parts.append((*self.byte_bits(rare, marker[rare_at]), rare_at))
        slots, bits, many, at = zip(*parts, strict=True)
        kinds = [np.full(len(bit), k, np.int64) for k, bit in enumerate(bits)]
        return np.concatenate(slots, 1), np.concatenate(bits), np.concatenate(kinds), np.concatenate([np.repeat(x, n) for x, n in zip(at, many)]), sizes, symbols, two, rare

    def count_symbols(self, k: int, context: np.ndarray | None, symbols: np.ndarray, out: np.ndarray) -> None:
        """Adds the symbols' bits to table ``k`` (a number for each slot and bit); equal symbols after equal contexts are worked on once."""
        own = symbols.astype(np.uint64)
        if context is not None:
            own |= context.astype(np.uint64) << np.uint64(32)
        self._count(own, lambda x: self._bits((x & np.uint64(0xFFFFFFFF)).astype(np.int64), self.lengths, self.codes), lambda x: None if context is None else _hash(2 * k, (x >> np.uint64(32)).astype(np.uint32)), out)

    def count_letters(self, k: int, stream, back, back2, marker, out: np.ndarray) -> None:
        """The same for the letters of spelled words."""
        wide = lambda x, at: x.astype(np.uint64) << np.uint64(at)
        own = wide(stream, 0) | wide(back, 9)
        if k:
            own |= wide(back2 if k == 1 else marker, 18)
        part = lambda x, at, bits: (x >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.uint32)
        context = (lambda x: _hash(5, part(x, 9, 9)), lambda x: _hash(6, part(x, 9, 9), part(x, 18, 9)), lambda x: _hash(8, part(x, 9, 9), part(x, 18, 32)))[k]
        self._count(own, lambda x: self._bits(part(x, 0, 9), self.byte_lengths, self.byte_codes), context, out)

    def _count(self, own: np.ndarray, bits_of, context_of, out: np.ndarray) -> None:
        own, times = np.unique(own, return_counts=True)
        for a in range(0, len(own), CHUNK_TOKENS):
            n, node, bit = bits_of(own[a : a + CHUNK_TOKENS])
            (slots,) = self._slots([context_of(own[a : a + CHUNK_TOKENS])], n, node)
            np.add.at(out, (slots << np.uint32(1) | bit).astype(np.intp), np.repeat(times[a : a + CHUNK_TOKENS].astype(out.dtype), n))

    def different(self, symbols, before, marker) -> tuple[np.ndarray, np.ndarray]:
        """The places of one token of each symbol, word before and very frequent word, and which of them each token is like."""
        if self.escape < MARKERS:  # unknown words are among the markers
            return np.arange(len(symbols)), np.arange(len(symbols))
        own = (before.astype(np.uint64) << np.uint64(7) | (marker & np.uint32(127)).astype(np.uint64)) << np.uint64(SYMBOL_BITS) | symbols.astype(np.uint64)
        return _alike(np.argsort(own), own)

    def different_letters(self, stream, back, back2, marker) -> tuple[np.ndarray, np.ndarray]:
        """The places of one letter of each kind, two before and very frequent word, and which of them each letter is like."""
        if self.escape < MARKERS:
            return np.arange(len(stream)), np.arange(len(stream))
        own = ((marker & np.uint32(127)).astype(np.uint64) << np.uint64(9) | back2) << np.uint64(18) | (back << np.uint32(9) | stream)
        return _alike(_order(own, 34), own)

    def _slots(self, contexts, n, node):
        tree, out = node * np.uint32(0xC2B2AE35), np.empty((len(contexts), len(node)), np.uint32)
        for slot, c in zip(out, contexts, strict=True):
            mixed = (tree ^ _ALONE if c is None else tree ^ np.repeat(c, n)) * np.uint32(0x27D4EB2F)
            np.right_shift(mixed, np.uint32(32 - self.table_bits), out=slot)
        return out


#: How sure a stored log-odds is: unseen, weak, strong; by its byte.
_SURE = np.array([0 if b == 0 else 1 if abs(b if b < 128 else b - 256) < 20 else 2 for b in range(256)], np.uint8)


class Mixer:
    """Weights by gate and context, and the adaptive map, with what learning them needs."""

    def __init__(self, weights=None, refine=None):
        self.weights = np.full((GATES, CONTEXTS), 0.4) if weights is None else weights
        self.refine = refine
        self.curvature = np.tile(np.eye(CONTEXTS) * 50.0, (GATES, 1, 1))
        self.count = np.zeros(GATES)
        self.seen = np.zeros((GATES * STEPS, 2))

    def inputs(self, tables, slots, kinds):
        x = np.stack([t.take(s, mode="wrap") for t, s in zip(tables, slots, strict=True)])  # in range; without the check it is faster
        sure = _SURE.take(x[1].view(np.uint8), mode="clip") + _SURE.take(x[2].view(np.uint8), mode="clip") * np.uint8(CONFIDENCE)
        return x, sure.astype(np.int64) + kinds * CONFIDENCE**2

    def odds(self, x, gates):
        w = (self.weights / SCALE).astype(np.float32)
        z = w[:, 0].take(gates, mode="clip") * x[0]
        for k in range(1, CONTEXTS):
            z += w[:, k].take(gates, mode="clip") * x[k]
        return np.clip(z, -12, 12, out=z)

    def probability(self, x, gates):
        """That a bit is 1: half mixed, half from the adaptive map between its two nearest steps."""
        z = self.odds(x, gates)
        p = np.exp(-z)
        p += 1
        np.reciprocal(p, out=p)
        if self.refine is not None:
            z += 8
            z *= np.float32((STEPS - 1) / 16)
            np.clip(z, 0, np.float32(STEPS - 1.001), out=z)
            low = z.astype(np.int64)
            z -= low
            cell = gates * STEPS
            cell += low
            below = self.refine.take(cell, mode="clip")
            below += (self.refine[1:].take(cell, mode="clip") - below) * z
            p += below
            p *= np.float32(0.5)
        return np.clip(p, np.float32(1e-5), np.float32(1 - 1e-5), out=p)

    def log_probability(self, tables, slots, bits, n, kind: int) -> np.ndarray:
        """log10 of the probabilities of words of ``n`` bits each, all of the same kind."""
        p = self.probability(*self.inputs(tables, slots, kind))
        p -= bits == 0  # p - 1 for a bit 0
        np.abs(p, out=p)
        return np.add.reduceat(np.log(p, out=p), np.cumsum(n) - n, dtype=np.float64) / np.log(10)  # np.log10 isn't vectorised

    def learn(self, x, gates, bits):
        """One step of an online Newton method for each gate, on the bits as they come."""
        z = self.odds(x, gates)
        p = 1 / (1 + np.exp(-z))
        error, slope = bits - p, p * (1 - p)
        order = np.argsort(gates.astype(np.uint8), kind="stable")
        for g, mine in enumerate(np.split(order, np.cumsum(np.bincount(gates, minlength=GATES))[:-1])):
            if not len(mine):
                continue
            v = x[:, mine] / SCALE
            self.curvature[g] += (v * slope[mine]) @ v.T
            self.weights[g] += np.linalg.solve(self.curvature[g], v @ error[mine])
            self.count[g] += len(mine)
        step = np.rint(np.clip((self.odds(x, gates) + 8) * ((STEPS - 1) / 16), 0, STEPS - 1)).astype(np.int64)
        cell = gates * STEPS + step
        self.seen[:, 0] += np.bincount(cell, minlength=len(self.seen))
        self.seen[:, 1] += np.bincount(cell, bits, len(self.seen))


def _chunks(batches, column: int, coder: Coder, tokens: int = CHUNK_TOKENS, most: int = SPLIT_BYTES):
    """The batch, the place of the first document in it and the words of documents, about ``tokens`` at once."""
    for batch, first, many, words in split_pieces(batches, column, most):
        for a, some in Words.of(many, words, coder).chunks(tokens):
            yield batch, first + a, some


_CODERS: dict[str, Coder] = {}


def _coder(held, key: str) -> Coder:
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(*held.value)
    return _CODERS[key]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all rows of the single column of texts; counted in each task first."""

    def run(batches):
        import pyarrow as pa

        held, rows = [], 0
        for *_, words in split_pieces(batches, 0):
            word, n = words.value_counts().flatten()
            held.append(pa.table([word.cast(pa.binary()), n], names=["word", "n"]))
            rows += len(word)
            if rows >= 2 * COUNTED_WORDS:
                held = [pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])]
                rows = len(held[0])
                if rows >= COUNTED_WORDS:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches()

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words that occur so often that at most ``most`` words do: a threshold from the counts of counts."""
    of_counts = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n"))
    least, total = None, 0
    for r in of_counts.toLocalIterator():  # different counts, as many as the square root of the tokens at most
        total += r["words"]
        if total > most:
            break
        least = r["n"]
    return counts.where(F.col("n") >= least) if least is not None else counts.limit(0)


def gathered_tables(docs: DataFrame, held, key: str, table_bits: int) -> list[np.ndarray]:
    """Log-odds of every slot from all bits of the texts: added up piece by piece, then CONTEXTS * 2**table_bits bytes."""

    def count(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        coder, group = _coder(held, key), TaskContext.get().partitionId() // ADDED
        tables = np.zeros((CONTEXTS, 2 << coder.table_bits), np.uint32)
        spelled: list[np.ndarray] = []
        symbols: list[tuple[np.ndarray, ...]] = []

        def add_spelled() -> None:
            letters = [np.concatenate(x) for x in zip(*spelled, strict=True)]
            for k, table in enumerate(tables):
                coder.count_letters(k, *letters, table)
            spelled.clear()

        def add_symbols() -> None:
            own, *contexts = (np.concatenate(x) for x in zip(*symbols, strict=True))
            for k, context in enumerate([None, *contexts]):
                coder.count_symbols(k, context, own, tables[k])
            symbols.clear()

        for _, _, texts in _chunks(batches, 0, coder):
            _, own, before, marker, _, rare_at, rare = coder.tokens(texts)
            symbols.append((own.astype(np.uint32), before, marker))
            if sum(len(x) for x, *_ in symbols) >= COUNTED_TOKENS:
                add_symbols()
            if rare:
                spelled.append(coder.letters(rare, marker[rare_at])[:-1])
                if sum(len(x) for x, *_ in spelled) >= COUNTED_LETTERS:
                    add_spelled()
        if symbols:
            add_symbols()
        if spelled:
            add_spelled()
        pack = zstandard.ZstdCompressor(level=1)
        out = [(k, i, group, pack.compress(tables[k, 2 * i * PIECE : 2 * (i + 1) * PIECE].tobytes())) for k in range(CONTEXTS) for i in range((1 << coder.table_bits) // PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["k", "piece", "part", "counts"])

    def added(table):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        return sum(np.frombuffer(unpack.decompress(x), np.uint32).astype(np.uint64) for x in table.column("counts").to_pylist())

    def some(table):
        import pyarrow as pa
        import zstandard

        total = np.minimum(added(table), 0xFFFFFFFF).astype(np.uint32)
        return pa.table({"k": table.column("k")[:1], "piece": table.column("piece")[:1], "counts": pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())})

    def final(table):
        import pyarrow as pa

        n = added(table).astype(np.float64).reshape(-1, 2)
        odds = np.rint(np.clip(np.log((n[:, 1] + PRIOR) / (n[:, 0] + PRIOR)), -8.4, 8.4) * SCALE).astype(np.int8)
        return pa.table({"k": table.column("k")[:1], "piece": table.column("piece")[:1], "odds": pa.array([odds.tobytes()], pa.binary())})

    parts = docs.mapInArrow(count, "k int, piece int, part int, counts binary")
    sums = parts.groupBy("k", "piece", "part").applyInArrow(some, "k int, piece int, counts binary")
    tables = np.zeros((CONTEXTS, 1 << table_bits), np.int8)
    for r in sums.groupBy("k", "piece").applyInArrow(final, "k int, piece int, odds binary").collect():
        tables[r["k"], r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["odds"], np.int8)
    return list(tables)


def learned_mixer(docs: DataFrame, held, tables, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Weights and adaptive map, learned on (doc_id, text, shard) in shards by hash, each in its order; the shards' weights are averaged by their bits."""

    def learn(table):
        import pyarrow as pa

        coder, mixer = _coder(held, key), Mixer()
        texts = sorted(binary_list(table.column("text").combine_chunks()), key=lambda t: (t is not None, t))
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary())], names=["text"])
        for _, _, words in _chunks([batch], 0, coder, most=4 * LEARNED_BYTES):
            slots, bits, kinds, *_ = coder.events(words)
            x, gates = mixer.inputs(tables.value, slots, kinds)
            mixer.learn(x, gates, bits.astype(np.float64))
        rows = [(g * CONTEXTS + k, mixer.weights[g, k] * mixer.count[g], mixer.count[g]) for g in range(GATES) for k in range(CONTEXTS)]
        rows += [(GATES * CONTEXTS + i, ones, n) for i, (n, ones) in enumerate(mixer.seen.tolist())]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[j] for r in rows], pa.float64()) for j in (1, 2))], names=["i", "v", "n"])

    got = {r["i"]: (r["v"], r["n"]) for r in docs.groupBy("shard").applyInArrow(learn, "i int, v double, n double").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()}
    start = Mixer()
    weights = np.array([(got[i][0] / got[i][1] if i in got and got[i][1] else start.weights.flat[i]) for i in range(GATES * CONTEXTS)]).reshape(GATES, CONTEXTS)
    seen = np.array([got.get(GATES * CONTEXTS + i, (0.0, 0.0)) for i in range(GATES * STEPS)]).reshape(GATES, STEPS, 2)
    prior = 1 / (1 + np.exp(-np.linspace(-8, 8, STEPS)))
    refine = (seen[:, :, 0] + 20 * prior) / (seen[:, :, 1] + 20)
    return weights, refine.astype(np.float32).ravel()


def _narrow(data: np.ndarray) -> bytes:
    return data.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def _wide(parts: list[bytes]) -> np.ndarray:
    own = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, TOKEN_BYTES)
    return np.pad(own, ((0, 0), (0, 8 - TOKEN_BYTES))).view("<u8").ravel()


def _packed(x: np.ndarray, ascending: bool = False) -> bytes:
    """Small or ascending whole numbers, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(x, prepend=0).astype(np.uint32).tobytes() if ascending else x.astype(np.uint32).tobytes())


def _unpacked(data: bytes, ascending: bool = False) -> np.ndarray:
    import zstandard

    own = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint32)
    return np.cumsum(own, dtype=np.int64) if ascending else own


def token(context: np.ndarray, symbol: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Tokens as numbers. Probabilities are rounded down, so that those of all symbols still sum to one at most."""
    plain = np.minimum(np.ceil(-log_p / UNIT - 1e-9), (1 << PLAIN_BITS) - 1).astype(np.uint64)
    kept = context.astype(np.uint64) & np.uint64((1 << (8 * TOKEN_BYTES - SYMBOL_BITS - PLAIN_BITS)) - 1)
    return (kept << np.uint64(SYMBOL_BITS) | symbol.astype(np.uint64)) << np.uint64(PLAIN_BITS) | plain


def blended(data: np.ndarray, doc: np.ndarray, training: np.ndarray) -> np.ndarray:
    """log10 probabilities of the tokens' symbols in one shard, with what followed their contexts mixed in.

    ``data``: see :func:`token`; ``doc``: each token's document, ascending; ``training``: whether each token counts. A
    training document's own tokens are left out for itself.
    """

    def counts(code, bits):
        """Training tokens of the same code, those of the same document left out if it is a training one."""
        order = _order(code, bits)
        c, d, w = code[order], doc[order], training[order].astype(np.int64)
        fresh = np.r_[True, c[1:] != c[:-1]]
        own = fresh | np.r_[True, d[1:] != d[:-1]]
        total = lambda starts: np.add.reduceat(w, np.flatnonzero(starts))[np.cumsum(starts) - 1]
        out = np.empty(len(code), np.int64)
        out[order] = total(fresh) - total(own)  # a document's own tokens count nothing unless it is a training one
        return out

    plain = 10.0 ** (-(data & np.uint64((1 << PLAIN_BITS) - 1)).astype(np.float64) * UNIT)
    of_context = counts(data >> np.uint64(PLAIN_BITS + SYMBOL_BITS), 8 * TOKEN_BYTES - PLAIN_BITS - SYMBOL_BITS)
    seen = np.flatnonzero(of_context > 0)
    if len(seen):
        share = counts(data >> np.uint64(PLAIN_BITS), 8 * TOKEN_BYTES - PLAIN_BITS)[seen] / of_context[seen]
        kind = np.minimum(np.log2(of_context[seen]).astype(np.int64), SEEN_KINDS - 1)
        weight, learn = np.full(SEEN_KINDS, 0.5), training[seen]
        many = np.bincount(kind[learn], minlength=SEEN_KINDS)
        for _ in range(ROUNDS):
            w = weight[kind] * share
            part = w / (w + (1 - weight[kind]) * plain[seen])
            weight = (np.bincount(kind[learn], part[learn], SEEN_KINDS) + 0.5) / (many + 1)
        plain[seen] = weight[kind] * share + (1 - weight[kind]) * plain[seen]
    return np.log10(plain)


def _shard_sums(table):
    """Of one shard: each run's sums of log10 probabilities by document. Rows about documents (negative shards) pass.

    A run's documents are those with a token in the shard: their places in the run, how many tokens, whether they train.
    Sums travel in four bytes (rounded by 6e-8 of themselves; a token's probability is rounded by up to UNIT before).
    """
    import pyarrow as pa

    if table.column("shard")[0].as_py() < 0:
        return table.drop_columns(["shard", "data", "many"])
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("row", "data", "docs", "many")), strict=True))
    held = [_unpacked(x) for *_, x in rows]
    many = np.concatenate(held)
    doc = np.repeat(np.arange(len(many)), many >> 1)
    total = np.bincount(doc, blended(_wide([x for _, x, _, _ in rows]), doc, (many & 1).astype(bool)[doc]), len(many))
    cuts = np.cumsum([0, *map(len, held)])
    columns = {"row": pa.array([r[0] for r in rows], pa.int64()), "docs": pa.array([r[2] for r in rows], pa.binary()), "sums": pa.array([total[a:b].astype(np.float32).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())}
    names = [n for n in table.column_names if n not in ("shard", "data", "many")]
    return pa.table([columns[n] if n in columns else pa.nulls(len(rows), table.schema.field(n).type) for n in names], names=names)


def _run_sums(table):
    """Of one run: row, sum of each document, from the sums of all shards; every document has its end in one of them."""
    import pyarrow as pa

    parts = sorted(zip(*(table.column(c).to_pylist() for c in ("docs", "sums")), strict=True))
    place, sums = np.concatenate([_unpacked(p, ascending=True) for p, _ in parts]), np.concatenate([np.frombuffer(x, np.float32) for _, x in parts])
    total = np.bincount(place, sums)
    first = table.column("row")[0].as_py()
    return pa.table({"row": pa.array(np.arange(first, first + len(total))), "symbols": pa.array(total)})


def scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, mixer_fold: int = 3, vocabulary: int = VOCABULARY) -> DataFrame:
    """One row for each row of ``docs``: log10 probabilities of its text under the mixed model and under word counts.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (null without text).
    Training texts are those whose crc32 of the id modulo ``folds`` isn't ``held_out``; the mixer learns on
    ``mixer_fold``, its tables on the other training folds, contexts of two words on all training folds. A null or empty
    text is the end alone; a null id is in a training fold. Repeated rows are scored, and counted, one by one. Without
    training text every word is unknown. Results don't depend on the partitions of ``docs`` (but for rounding).
    """
    import uuid

    spark = docs.sparkSession
    key = uuid.uuid4().hex
    fold = crc_fold(id_col, folds)
    source = docs.select(F.col(id_col).alias("doc_id"), fold.alias("fold"), F.col(text_col).alias("text"))
    training = source.where(F.col("fold") != held_out)
    counts = written(word_counts(training.select("text")), "words")
    ends, octets = training.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    known, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, different = known + ends, distinct + (ends > 0)
    top = [(bytes(r["word"]), r["n"]) for r in frequent(counts, vocabulary).collect()]  # at most `vocabulary` rows
    top.sort(key=lambda x: (-x[1], x[0]))
    table_bits = min(max(int(tokens).bit_length(), LEAST_BITS), MOST_BITS)
    held = spark.sparkContext.broadcast((top, tokens, ends, table_bits))
    tables = spark.sparkContext.broadcast(gathered_tables(training.where(F.col("fold") != mixer_fold).select("text"), held, key, table_bits))
    mixed = training.where(F.col("fold") == mixer_fold).select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-int(octets) // (LEARNED_BYTES * folds))))).alias("shard"))
    weights, refine = learned_mixer(mixed, held, tables, key)
    shards = max(LEAST_SHARDS, tokens // SHARD_TOKENS)
    id_type = docs.schema[id_col].dataType.simpleString()
    of_doc = f"row long, doc_id {id_type}, fold long, n_tokens long, sure long, base double, spelled double, octets long, rare array<long>, times array<int>, docs binary, sums binary"

    def score(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        coder, mixer, row = _coder(held, key), Mixer(weights, refine), TaskContext.get().partitionId() << 40
        run, waiting, folds_of, n = row, [], [], 0
        kinds_of = None

        def dealt():
            """Of the documents since ``run``: a row for each shard, the tokens in the documents' order."""
            data, shard, doc = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.argsort(shard.astype(np.uint16) if shards < 65_536 else shard, kind="stable")
            data, doc, shard = data[order], doc[order], shard[order]
            here = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            flags, rows = np.array(folds_of, np.uint32), []
            for a, b in zip(here.tolist(), [*here[1:].tolist(), len(shard)]):
                own, n_own = np.unique(doc[a:b], return_counts=True)
                rows.append((int(shard[a]), run, _narrow(data[a:b]), _packed(own, ascending=True), _packed(n_own.astype(np.uint32) << 1 | flags[own])))
            columns = dict(zip(("shard", "row", "data", "docs", "many"), zip(*rows, strict=True), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(rows), f.type) for f in kinds_of], schema=kinds_of)

        for batch, at_row, words in _chunks(batches, 2, coder, WINDOW_TOKENS):
            sizes, symbols, before, marker, two, rare_at, rare = coder.tokens(words)
            many, place = len(sizes), pa.array(np.arange(at_row, at_row + len(sizes)))
            doc = np.repeat(np.arange(many), sizes)
            first, like = coder.different(symbols, before, marker)
            pieces = [first[a : a + CHUNK_TOKENS] for a in range(0, len(first), CHUNK_TOKENS)]
            of_symbol = np.concatenate([mixer.log_probability(tables.value, *coder.symbol_bits(symbols[x], before[x], marker[x]), 0) for x in pieces])[like]
            spelled = np.zeros(many)
            for a in range(0, len(rare), SPELLED_WORDS):
                at = rare_at[a : a + SPELLED_WORDS]
                *letters, n_own = coder.letters(rare[a : a + SPELLED_WORDS], marker[at])
                first, like = coder.different_letters(*letters)
                pieces = [first[b : b + CHUNK_TOKENS] for b in range(0, len(first), CHUNK_TOKENS)]
                of_letter = np.concatenate([mixer.log_probability(tables.value, *coder.letter_bits(*(c[x] for c in letters)), 1) for x in pieces])[like]
                spelled += np.bincount(np.repeat(doc[at], n_own), of_letter, many)
            waiting.append((token(two, symbols, of_symbol), ((two >> np.uint64(32)) % np.uint64(shards)).astype(np.int64), doc + len(folds_of)))
            folds_of += [x != held_out for x in batch.column(1).take(place).to_pylist()]
            base = np.bincount(doc, coder.log_counts[symbols], many)
            sure = np.bincount(doc, (symbols != coder.escape) & ((symbols != coder.end) | (ends > 0)), many).astype(np.int64)
            # Of each document its different unknown words, as hashes, and how often it has them.
            pairs, times = np.unique(doc[rare_at] * len(words.different) + words.at[rare_at - doc[rare_at]], return_counts=True)
            of_doc_at = pa.array(np.searchsorted(pairs, np.arange(many + 1) * len(words.different)), pa.int32())
            asked, like = np.unique(pairs % max(1, len(words.different)), return_inverse=True)
            hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in words.spelled(asked)], np.uint64).view(np.int64)[like]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(many, -1 - run)), pa.array(np.arange(row, row + many)), batch.column(0).take(place), batch.column(1).take(place), pa.array(sizes.astype(np.int64)), pa.array(sure), pa.array(base), pa.array(spelled),
                    pa.array(words.octets()),
                    pa.ListArray.from_arrays(of_doc_at, pa.array(hashes)), pa.ListArray.from_arrays(of_doc_at, pa.array(times, pa.int32())),
                    *(pa.nulls(many, pa.binary()) for _ in range(4)),
                ],
                names=["shard", "row", "doc_id", "fold", "n_tokens", "sure", "base", "spelled", "octets", "rare", "times", "docs", "sums", "data", "many"],
            )
            kinds_of = out.schema
            yield out
            row += many
            n += len(symbols)
            if n >= RUN_TOKENS:
                yield dealt()
                run, waiting, folds_of, n = row, [], [], 0
        if waiting:
            yield dealt()

    dealt_rows = source.mapInArrow(score, f"shard long, {of_doc}, data binary, many binary")
    scored = written(dealt_rows.groupBy("shard").applyInArrow(_shard_sums, of_doc), "scores")
    by_row = scored.where("sums is not null").select("row", "docs", "sums").groupBy("row").applyInArrow(_run_sums, "row long, symbols double")
    scored = scored.where("sums is null").drop("docs", "sums")
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    rest = pairs.join(counts.select(F.xxhash64("word").alias("h"), F.col("n").alias("c")), "h").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("times").alias("many"))
    denominator = F.log10(F.lit(float(tokens + different + 1)))
    return scored.drop("rare", "times").join(by_row, "row").join(rest, "row", "left").withColumn("score", F.col("symbols") + F.col("spelled")).select(
        "doc_id", (F.col("fold") == held_out).alias("held_out"), "n_tokens", (F.col("sure") + F.coalesce("many", F.lit(0))).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * denominator).alias("base_score"), "score",
        F.when(F.col("octets") > 0, -F.col("score") * F.log2(F.lit(10.0)) / F.col("octets")).alias("bits_per_byte"),
    )
