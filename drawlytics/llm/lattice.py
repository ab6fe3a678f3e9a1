"""Subword lattice likelihood: a unigram vocabulary, all segmentations summed in log space."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

from drawlytics.llm.common import mixed, shared, whole_text
from drawlytics.plans.store import materialize

#: Bytes of text that share one list of words.
CHUNK_BYTES = 12 << 20
#: Words longer than this many bytes go one by one, not in blocks.
BLOCK_BYTES = 48
BLOCK_WORDS = 4096
HASH = 0xD6E8FEB86659FD93
BITS = 20


def _log_sum(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high)) if low > -math.inf else high


class Lattice:
    """Pieces that begin a word (without their mark) and pieces that go on, with log weights.

    A word is a first piece, any number of further pieces, then a stop. Either
    kind of weights sums to one, so the words' probabilities do too. Every byte
    is a further piece, so every word has a segmentation.
    """

    def __init__(self, first: dict[bytes, int], more: dict[bytes, int]):
        self.first, self.more = first, more
        self.longest = max(map(len, [*first, *more]))
        self.tables = [self._table(x) for x in (first, more)]
        self.n = len(first) + len(more) + 1
        self.stop = self.n - 1
        self.weights = np.empty(0)

    @classmethod
    def read(cls, model_path: str) -> Lattice:
        """Pieces of a sentencepiece file; byte pieces are single bytes. Weights fall with the rank."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        first: dict[bytes, float] = {}
        more: dict[bytes, float] = {}
        mark = "\u2581"
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                more.setdefault(bytes([int(piece[3:5], 16)]), 1e6)
            elif not (model.is_control(i) or model.is_unknown(i)):
                rank = max(0.0, -model.get_score(i))
                if piece.startswith(mark):
                    first.setdefault(piece[1:].encode(), rank)
                elif mark not in piece:
                    more[piece.encode()] = min(rank, more.get(piece.encode(), rank))
        for b in range(256):
            more.setdefault(bytes([b]), 1e6)
        first.setdefault(b"", 0.0)
        lattice = cls({p: i for i, p in enumerate(first)}, {p: len(first) + i for i, p in enumerate(more)})
        lattice.set_weights(np.array([1 / (r + 10) for r in [*first.values(), *more.values(), 0.0]]))
        return lattice

    def set_weights(self, expected: np.ndarray) -> None:
        k = len(self.first)
        self.weights = np.log(np.concatenate([expected[:k] / expected[:k].sum(), expected[k:] / expected[k:].sum()]))

    def _table(self, pieces: dict[bytes, int]) -> tuple:
        """Sorted hashes of the pieces with their ids, and a bitmap of the hashes' high bits."""
        own = {p: i for p, i in pieces.items() if p}
        keys = np.zeros(len(own), dtype=np.uint64)
        for at, p in enumerate(own):
            h = 0
            for b in p:
                h = (h * HASH + b + 1) % (1 << 64)
            keys[at] = h
        keys = mixed(keys)
        order = np.argsort(keys)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        known = np.zeros(1 << BITS, dtype=bool)
        known[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True
        return keys[order], np.array(list(own.values()), dtype=np.int64)[order], known

    def _look_up(self, hashes: np.ndarray, table: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and the pieces' ids."""
        keys, ids, known = table
        maybe = np.flatnonzero(known[(hashes >> np.uint64(64 - BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
        found = keys[place] == hashes[maybe]
        return maybe[found], ids[place[found]]

    def arcs(self, block: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, piece ids) of all pieces in words of equal length; from -1: the word's beginning."""
        n, size = block.shape
        out = []
        for i in range(size):
            h = np.zeros(n, dtype=np.uint64)
            for j in range(i, min(size, i + self.longest)):
                h = h * np.uint64(HASH) + block[:, j] + np.uint64(1)
                key = mixed(h)
                if i == 0:
                    rows, ids = self._look_up(key, self.tables[0])
                    out.append((-1, j + 1, rows, ids))
                rows, ids = self._look_up(key, self.tables[1])
                out.append((i, j + 1, rows, ids))
        return sorted((a for a in out if len(a[2])), key=lambda a: (a[0], a[1]))

    def forward(self, n: int, size: int, arcs: list) -> np.ndarray:
        """Log weight of every prefix of every word, all segmentations summed."""
        alpha = np.full((size + 1, n), -np.inf)
        alpha[0] = self.weights[self.first[b""]]
        for i, j, rows, ids in arcs:
            before = self.weights[ids] if i < 0 else alpha[i, rows] + self.weights[ids]
            alpha[j, rows] = np.logaddexp(alpha[j, rows], before)
        return alpha

    def expect(self, block: np.ndarray) -> np.ndarray:
        """Expected uses of every piece in words of equal length."""
        n, size = block.shape
        arcs = self.arcs(block)
        alpha = self.forward(n, size, arcs)
        beta = np.full((size + 1, n), -np.inf)
        beta[size] = 0.0
        uses = np.zeros(self.n)
        for i, j, rows, ids in reversed(arcs):
            after = beta[j, rows] + self.weights[ids]
            before = 0.0 if i < 0 else alpha[i, rows]
            uses += np.bincount(ids, np.exp(before + after - alpha[size, rows]), self.n)
            if i >= 0:
                beta[i, rows] = np.logaddexp(beta[i, rows], after)
        uses[self.first[b""]] += np.exp(alpha[0] + beta[0] - alpha[size]).sum()
        uses[self.stop] += n
        return uses

    def blocks(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(places, byte block) of words of equal length; long words come alone, without a block."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            if len(group) and size[group[0]] > BLOCK_BYTES:
                yield from ((np.array([i]), None) for i in group)
                continue
            for first in range(0, len(group), BLOCK_WORDS):
                own = group[first : first + BLOCK_WORDS]
                yield own, np.frombuffer(b"".join([words[i] for i in own.tolist()]), dtype=np.uint8).reshape(len(own), -1).astype(np.uint64)

    def _word_arcs(self, word: bytes) -> Iterator[tuple[int, int, int]]:
        """(from, to, piece id) of all pieces in one word, by their ends; from -1: the word's beginning."""
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - self.longest), j):
                if (k := self.more.get(word[i:j])) is not None:
                    yield i, j, k
            if j <= self.longest and (k := self.first.get(word[:j])) is not None:
                yield -1, j, k

    def _word_forward(self, word: bytes) -> tuple[list, list[float]]:
        """The arcs of one word and the log weight of its every prefix."""
        arcs, weights = list(self._word_arcs(word)), self.weights
        alpha = [-math.inf] * (len(word) + 1)
        alpha[0] = weights[self.first[b""]]
        for i, j, k in arcs:
            alpha[j] = _log_sum(alpha[j], weights[k] if i < 0 else alpha[i] + weights[k])
        return arcs, alpha

    def long_word(self, word: bytes) -> float:
        """Log probability of one word, byte by byte."""
        return self._word_forward(word)[1][-1] + self.weights[self.stop]

    def expect_long(self, word: bytes) -> np.ndarray:
        """:meth:`expect` for one word, byte by byte."""
        arcs, alpha = self._word_forward(word)
        beta = [-math.inf] * len(word) + [0.0]
        uses = np.zeros(self.n)
        for i, j, k in reversed(arcs):
            after = beta[j] + self.weights[k]
            uses[k] += math.exp((0.0 if i < 0 else alpha[i]) + after - alpha[-1])
            if i >= 0:
                beta[i] = _log_sum(beta[i], after)
        uses[self.first[b""]] += math.exp(alpha[0] + beta[0] - alpha[-1])
        uses[self.stop] += 1
        return uses

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of every word's marginal probability."""
        out = np.empty(len(words))
        for place, block in self.blocks(words):
            if block is None:
                out[place] = self.long_word(words[place[0]])
            elif block.shape[1]:
                out[place] = self.forward(*block.shape, self.arcs(block))[-1] + self.weights[self.stop]
        return out


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per chunk of texts: its distinct words with training counts, and the texts as word numbers."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), (F.pmod(F.crc32(key), F.lit(10)) == 0).alias("held"), whole_text(text_col).alias("text"))
    schema = StructType.fromDDL("chunk long, words array<binary>, n_train array<int>").add("ids", ArrayType(slim.schema["id"].dataType))
    for field in StructType.fromDDL("held array<boolean>, sizes array<int>, tokens binary, chars long").fields:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 32)
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            ends = np.cumsum([len(t) + 1 for t in texts])
            group = (ends - 1) // CHUNK_BYTES if len(texts) else ends
            for own in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(group)) + 1):
                if not len(own):
                    continue
                vocabulary: dict[bytes, int] = defaultdict(count().__next__)
                parts = [np.fromiter(map(vocabulary.__getitem__, w), np.int32, len(w)) for w in (texts[i].lower().split() for i in own.tolist())]
                sizes = np.array([len(p) for p in parts], dtype=np.int32)
                tokens = np.concatenate(parts) if parts else np.empty(0, np.int32)
                rows = batch.slice(int(own[0]), len(own))
                held = rows.column(1).to_numpy(zero_copy_only=False)
                train = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(vocabulary)).astype(np.int32)
                values = [
                    [next(number)], [list(vocabulary)], [train], [rows.column(0)], [held], [sizes],
                    [zip_.compress(tokens.astype("<i4").tobytes())], [sum(len(texts[i]) for i in own.tolist())],
                ]
                kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(batch.column(0).type), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.int64()]
                arrays = [pa.array(v, k) if not isinstance(v[0], pa.Array) else pa.ListArray.from_arrays(pa.array([0, len(v[0])], pa.int32()), v[0]) for v, k in zip(values, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return slim.mapInArrow(run, schema)


def learn_weights(words: DataFrame, lattice: Lattice, turns: int) -> Lattice:
    """Piece weights that fit the distinct words (``word``), by expectation and maximisation.

    Each turn sums expected uses per task; what reaches the driver is one number
    per piece of the vocabulary. Every piece keeps a little weight.
    """
    spark = words.sparkSession
    for _ in range(turns):
        held = shared(spark, lattice)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            model = held()
            uses = np.zeros(model.n)
            for batch in batches:
                words = batch.column(0).to_pylist()
                for place, block in model.blocks(words):
                    uses += model.expect_long(words[place[0]]) if block is None else model.expect(block)
            piece = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(uses[piece])], names=["piece", "uses"])

        sums = words.select("word").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        expected = np.full(lattice.n, 0.01)
        for r in sums:
            expected[r["piece"]] += r["uses"]
        lattice.set_weights(expected)
    return lattice


def scores(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", turns: int = 2, smoothing: float = 0.1) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    Rows with ``crc32(id as text) mod 10 = 0`` are held out (a null id counts as
    the empty text); the rest trains. Tokens are the words, A-Z lower-cased, and
    one end per text; a null text has only the end. ``base_score`` is the
    smoothed word unigram. ``score`` is log10 of the marginal probability over all
    segmentations of the lattice whose arcs are the vocabulary's pieces and the
    training words: a token is a training word or the end with probability
    ``1 - e``, by its count, or is spelled in pieces with probability ``e``, the
    share of words seen once. Piece weights start from the vocabulary's scores and
    take ``turns`` of expectation and maximisation over the distinct training words. Repeated rows count and come back as often; other columns are
    ignored; an empty table gives no rows. Without training rows every score is
    spelled.
    """
    chunks = materialize(chunked(docs, id_col, text_col), "chunks")
    words = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "n_train")).alias("place", "x")).select("chunk", "place", "x.words", "x.n_train")
    counts = materialize(words.groupBy(F.col("words").alias("word")).agg(F.sum("n_train").alias("c")), "counts")
    ends = chunks.agg(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    n, v, once = counts.agg(F.sum("c"), F.count_if(F.col("c") > 0), F.count_if(F.col("c") == 1)).first()
    total, kinds = (n or 0) + ends, (v or 0) + (ends > 0)
    spelled = min(0.5, max(1e-6, (once or 0) / total)) if total else 1.0
    lattice = learn_weights(counts.where("c > 0"), Lattice.read(model_path), turns if v else 0)
    held = shared(docs.sparkSession, lattice)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held()
        for batch in batches:
            c = batch.column(1).to_numpy()
            p = model.log_probabilities(batch.column(0).to_pylist()) + math.log(spelled)
            if total:
                with np.errstate(divide="ignore"):
                    p = np.logaddexp(p, np.log((1 - spelled) * c / total))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p / math.log(10))], names=["word", "c", "p"])

    known = counts.mapInArrow(spell, "word binary, c long, p double")
    placed = words.select("chunk", "place", F.col("words").alias("word")).join(known, "word").select((F.col("chunk") + 0).alias("own"), "place", "c", "p")

    def base(c: np.ndarray | int) -> np.ndarray:
        return np.log10((c + smoothing) / (total + smoothing * (kinds + 1)))

    end = math.log10((1 - spelled) * ends / total) if ends else (math.log10(spelled) + lattice.weights[lattice.first[b""]] + lattice.weights[lattice.stop])

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0] if left.num_rows else None
        if row is None:
            return pa.table({k: pa.array([], t) for k, t in zip(names, types)})
        place = right.column("place").to_numpy()
        c, p = np.zeros(len(place), np.int64), np.zeros(len(place))
        c[place], p[place] = right.column("c").to_numpy(), right.column("p").to_numpy()
        sizes = np.array(row["sizes"], dtype=np.int64)
        tokens = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), dtype="<i4")
        text = np.repeat(np.arange(len(sizes)), sizes)
        sums = [np.bincount(text, w[tokens], len(sizes)) for w in (base(c), p, (c > 0).astype(float))]
        m = len(sizes)
        values = [row["ids"], row["held"], sizes + 1, sums[2].astype(np.int64) + (ends > 0), np.full(m, total), sums[0] + base(ends), sums[1] + end]
        return pa.table({k: pa.array(v, t) for k, v, t in zip(names, values, types)})

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = docs.select(F.col(id_col)).schema
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(schema[0].dataType), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    for name, kind in zip(names[1:], ("boolean", "long", "long", "long", "double", "double")):
        schema = schema.add(name, kind)
    slim = chunks.select("chunk", "ids", "held", "sizes", "tokens")
    return slim.groupBy("chunk").cogroup(placed.groupBy("own")).applyInArrow(score, schema)
