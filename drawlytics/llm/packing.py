"""Best-fit packing of tokenised documents, certified by dual-feasible-function bounds."""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from drawlytics.llm.common import whole_text
from drawlytics.plans.store import materialize

STOPS = b".,;:!?*#%$&"
#: A private character and its first byte, which no other character has but its neighbours.
SEPARATOR, MARK = "\ue000", b"\xee"
LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
PROBE = "abcdefghijklmnopqrstuvwxyz"


def _plain_letters(word: bytes) -> bool:
    """Letters a-z alone: bytes know no other letters than those of ASCII."""
    return word.isalpha() and word.islower()


class WordEncoder:
    """Little-endian ids of texts, for tokenizers that never join what white space parts.

    Keeps the ids of up to ``most`` words. ASCII stops after a letter are a word
    of their own to such a tokenizer, so they are peeled off before encoding. If
    the tokenizer lower-cases, words that differ by the case of A-Z are encoded once.
    Words of a-z alone go to the tokenizer's model if what comes before it leaves
    them whole and unchanged.
    """

    def __init__(self, path: str, most: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}
        rule = json.loads(self.tokenizer.to_str()).get("normalizer") or {}
        self.lowers = any(r["type"] == "Lowercase" for r in [rule, *rule.get("normalizers", ())] if r)
        # Added tokens are found before texts are lower-cased.
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        before, after = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        whole = (not before or before.normalize_str(PROBE) == PROBE) and after and [x for x, _ in after.pre_tokenize_str(PROBE)] == [PROBE]
        self.model = self.tokenizer.model if whole and not any(_plain_letters(x) for x in self.added) else None

    def _ids(self, text: str) -> np.ndarray:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, dtype="<u4")

    def _joined(self, words: list[bytes]) -> list[bytes]:
        """Ids of words encoded as one text, parted by a word that none of them can hold a token of."""
        mark = self._ids(SEPARATOR)
        ids = self._ids(f" {SEPARATOR} ".join([w.decode() for w in words]))
        cuts = 4 * np.flatnonzero(ids == mark[0])
        if len(cuts) != len(words) - 1:
            return [self._ids(w.decode()).tobytes() for w in words]
        line, starts = ids.tobytes(), [0, *(cuts + 4 * len(mark)).tolist()]
        return [line[a:b] for a, b in zip(starts, [*cuts.tolist(), len(line)])]

    def _plain(self, word: bytes) -> bytes:
        """A word of the same ids, in lower case if the tokenizer makes it so."""
        low = word.lower()
        return word if low == word or any(x in low for x in self.added) else low

    def learn(self, found: set[bytes]) -> None:
        """Adds the ids of words that are not known."""
        if self.lowers:
            plain = {w: self._plain(w) for w in found}
            self._learn(set(plain.values()).difference(self.known))
            self.known.update((w, self.known[p]) for w, p in plain.items() if p is not w)
        else:
            self._learn(found)

    def _learn(self, found: set[bytes]) -> None:
        known, need, peeled = self.known, [], []
        for w in found:
            s = w.rstrip(STOPS)
            if s and s != w and s[-1] in LETTERS:
                peeled.append((w, s, w[len(s) :]))
            else:
                need.append(w)
        need += {x for _, s, tail in peeled for x in (s, tail) if x not in known and x not in found}
        if self.model is not None:
            tokenize = self.model.tokenize
            straight = [w for w in need if _plain_letters(w)]
            ids = [[t.id for t in tokenize(w.decode())] for w in straight]
            flat = np.fromiter((i for own in ids for i in own), dtype="<u4").tobytes()
            ends = (4 * np.cumsum([len(own) for own in ids], dtype=np.int64)).tolist()
            known.update((w, flat[a:b]) for w, a, b in zip(straight, [0, *ends], ends))
            need = [w for w in need if not _plain_letters(w)]
        rare = [w for w in need if MARK in w]
        need = [w for w in need if MARK not in w] if rare else need
        for first in range(0, len(need), 2048):
            some = need[first : first + 2048]
            known.update(zip(some, self._joined(some)))
        known.update((w, self._ids(w.decode()).tobytes()) for w in rare)
        for w, s, tail in peeled:
            known[w] = known[s] + known[tail]

    def encode(self, texts: pa.Array, end: bytes) -> Iterator[bytes]:
        for first in range(0, len(texts), 128):
            part = [(t or b"").split() for t in texts.slice(first, 128).cast(pa.binary()).to_pylist()]
            if len(self.known) > self.most:
                self.known.clear()
            missing = set().union(*part).difference(self.known)
            if missing:
                self.learn(missing)
            get = self.known.__getitem__
            for found in part:
                yield b"".join(map(get, found)) + end


def worker_encoder(path: str, most: int) -> WordEncoder:
    """This Python worker's encoder: a worker that takes several tasks keeps the words it knows."""
    store = sys.modules.setdefault("_drawlytics_worker", ModuleType("_drawlytics_worker"))
    own = getattr(store, "encoder", None)
    if own is None or own[0] != (path, most):
        store.encoder = own = (path, most), WordEncoder(path, most)
    return own[1]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, end_id: int, known_words: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document cut at ``capacity`` tokens."""
    slim = docs.select(F.col(id_col), whole_text(text_col).alias("_text"))
    schema = slim.select(F.col(slim.columns[0])).schema
    schema = schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = worker_encoder(tokenizer_path, known_words), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for at, ids in enumerate(encoder.encode(batch.column(1), end)):
                for k, first in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[first : first + 4 * capacity]
                    rows.append((at, k, k * capacity, len(part) // 4, zlib.crc32(part)))
            at, k, start, length, crc = map(list, zip(*rows)) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=schema.names,
            )

    return slim.mapInArrow(run, schema)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The most bins that dual-feasible functions prove necessary for these sizes.

    The family of Martello and Toth (small items dropped, large ones rounded up)
    and u^(k) for k up to 20, in whole numbers.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int(sizes.sum()) // capacity)
    number, total = np.cumsum(count), np.cumsum(count * size)
    for a in range(0, capacity // 2 + 1):
        large = number[-1] - number[capacity - a]
        half = capacity // 2
        medium = number[capacity - a] - number[half]
        room = int(medium) * capacity - int(total[capacity - a] - total[half])
        small = int(total[half] - (total[a - 1] if a else 0))
        best = max(best, int(large + medium) + max(0, -(-(small - room) // capacity)))
    for k in range(2, 21):
        times = (k + 1) * size
        value = np.where(times % capacity == 0, size * k, times // capacity * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size: largest first, each into the fullest bin with room."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0  # bit r of rooms: a bin with room r is open
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        if left:
            if not open_bins[left]:
                rooms |= 1 << left
            open_bins[left].append(b)
    return bins, offsets


def _pack_parts(rows: DataFrame, parts: int, turn: int, capacity: int) -> DataFrame:
    """Best-fit decreasing in each of ``parts`` random parts.

    ``again``: the row should be packed anew with others: all rows of a part
    with more bins than its bound, else those of its emptiest bin.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(parts)))
    schema = StructType(list(dealt.schema.fields)).add("_bin", "long").add("offset", "long").add("_again", "boolean").add("_gap", "boolean")

    def run(table: pa.Table) -> pa.Table:
        # Rows come in any order; ties go by row number, so a rerun packs alike.
        table = table.sort_by("_row")
        sizes = table.column("length").to_numpy().astype(np.int64)
        bins, offsets = best_fit(sizes, capacity)
        made = int(bins.max()) + 1
        gap = made > lower_bound(sizes, capacity)
        fill = np.bincount(bins, weights=sizes)
        again = np.full(len(sizes), True) if gap else (bins == int(np.argmin(fill))) & (fill.min() < capacity)
        for name, values in (("_bin", bins), ("offset", offsets), ("_again", again), ("_gap", np.full(len(sizes), gap))):
            table = table.append_column(name, pa.array(values))
        return table

    return dealt.groupBy("_part").applyInArrow(run, schema)


def pack(rows: DataFrame, capacity: int = 4096, part_tokens: int = 1 << 24, turns: int = 5) -> DataFrame:
    """``rows`` (with ``length`` from 1 to ``capacity``) plus ``sequence_id``, ``offset`` and ``certified``.

    Full rows are sequences of their own. The rest is dealt at random into parts
    of about ``part_tokens`` tokens; a part whose bin count equals its lower bound
    is final but for its emptiest bin; parts with a gap give back all their rows.
    What was given back is dealt anew, into fewer parts, until one part is left,
    ``turns`` are over, or nothing was gained. ``certified`` says of a sequence that
    the part it was packed in has as few bins as its lower bound.
    """
    stored = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    columns = [*rows.columns, "_row"]
    full = stored.where(F.col("length") == capacity)
    done = [full.select(*columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))]
    left = stored.where(F.col("length") < capacity)
    previous: DataFrame | None = None
    for turn in range(turns):
        tokens = left.agg(F.sum("length")).first()[0]
        if not tokens:
            break
        parts = max(1, -(-tokens // part_tokens))
        packed = materialize(_pack_parts(left, parts, turn, capacity), "packed")
        packed = packed.withColumn("certified", ~F.col("_gap")).withColumn("sequence_id", F.lit(turn << 56) + F.col("_part") * (1 << 26) + F.col("_bin"))
        if previous is not None:
            # Kept only if the new turn needs fewer sequences for the same rows.
            before, now = (x.agg(F.count_distinct("sequence_id")).first()[0] for x in (previous, packed))
            if now >= before:
                done.append(previous.select(*columns, "sequence_id", "offset", "certified"))
                break
        last = parts == 1 or turn == turns - 1
        done.append((packed if last else packed.where("NOT _again")).select(*columns, "sequence_id", "offset", "certified"))
        if last:
            break
        previous = materialize(packed.where("_again"), "again")
        left = previous.select(*columns)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.drop("_row")


def packed(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 1,
    known_words: int = 1_000_000,
    part_tokens: int = 1 << 24,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset, certified) per piece of every document.

    A document is the tokenizer's ids of its text, then ``end_id``; a null or
    empty text is that id alone. Only documents over ``capacity`` tokens are cut.
    Null ids and repeated rows are packed like any other; other columns are
    ignored; an empty table gives no rows. ``known_words`` bounds the words a
    Python worker remembers, without effect on the ids.
    """
    return pack(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, known_words), capacity, part_tokens)
