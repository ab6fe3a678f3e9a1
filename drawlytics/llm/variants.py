"""Spelling variants: bidirectional FM-indexes of the vocabulary, searched with one half exact and one error in the other."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from drawlytics.llm.common import whole_text
from drawlytics.plans.store import materialize

LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Ends words in the index and in prefixes; no word holds it.
END = "$"
#: Shortest part of a word that a search leaves exact, and so the shortest prefix that places a word.
LEAST = 3
#: Symbols of an index: end of text, end of word, then the letters.
STOP, BREAK = 0, 1
#: Bytes of one table of ranks.
RANKS = 1 << 26


def counted(docs: DataFrame, least: int, every: int, most_held: int = 500_000) -> DataFrame:
    """(word, n) over all texts of ``docs`` (id, text), words of ``least`` code points or more."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def rows(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = runs.findall(text.as_py().encode("utf-8", "replace").translate(LOWER_BYTES).decode())
                start = zlib.crc32(f"{'' if own is None else own}:".encode())
                for word, n in Counter(found).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    total[word] += n
                if len(total) > most_held:
                    yield rows(total)
                    total.clear()
        yield rows(total)

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling the compared length."""
    n, rank, k = len(text), text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while n > 1:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - k)] = rank[k:] + 1
        key = rank * (max(n, int(rank.max())) + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


class Direction:
    """Suffix ranks of a text: how an interval narrows when a symbol is put before its pattern."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.suffixes = suffix_array(text)
        self.last = text[self.suffixes - 1]
        self.step = 1
        while len(text) // self.step * symbols * 4 > RANKS:
            self.step *= 2
        marks = np.zeros((len(text) // self.step + 2, symbols), dtype=np.int32)
        np.add.at(marks, (np.arange(len(text)) // self.step + 1, self.last), 1)
        self.marks = np.cumsum(marks, axis=0, dtype=np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))[:-1]])

    def before(self, place: np.ndarray) -> np.ndarray:
        """Uses of every symbol among the last symbols of the suffixes ranked below ``place``."""
        out = self.marks[place // self.step]
        base = place // self.step * self.step
        for k in range(self.step - 1):
            more = np.flatnonzero(base + k < place)
            out[more, self.last[base[more] + k]] += 1
        return out

    def before_of(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = self.marks[place // self.step, symbol]
        base = place // self.step * self.step
        for k in range(self.step - 1):
            more = base + k < place
            out = out + (more & (self.last[np.where(more, base + k, 0)] == symbol))
        return out


class Index:
    """A bidirectional FM-index of different words: the delimited text, and the same text reversed."""

    def __init__(self, words: list[str], others: list[str]):
        text = np.frombuffer((END + END.join([*words, ""])).encode("utf-32-le"), dtype="<u4")
        rest = np.frombuffer("".join(others).encode("utf-32-le"), dtype="<u4")
        letters = np.unique(np.concatenate([text, rest]))
        self.letters = letters[letters != ord(END)]
        self.symbols = len(self.letters) + 2
        text = np.where(text == ord(END), BREAK, np.searchsorted(self.letters, text) + 2)
        self.breaks = np.flatnonzero(text == BREAK)
        self.size = len(text) + 1
        self.left = Direction(np.append(text, STOP), self.symbols)
        self.right = Direction(np.append(text[::-1], STOP), self.symbols)

    def spelled(self, words: list[str]) -> np.ndarray:
        """Symbols of words of one length, a row each."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1)
        return np.searchsorted(self.letters, code) + 2

    def one_error(self, words: np.ndarray, half: int, prefix: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, indexed word) of all words one edit from a row of ``words``, the edit behind its first ``half``
        symbols (``prefix``) or before the rest.

        The exact part is matched from the middle outwards to its end of word,
        keeping the intervals of both directions; the other part is then matched
        from the middle in the other direction, with one error.
        """
        bound = np.full((len(words), 1), BREAK)
        left = np.hstack([words[:, :half][:, ::-1], bound])
        right = np.hstack([words[:, half:], bound])
        exact, rest = (left, right) if prefix else (right, left)
        near, far = (self.left, self.right) if prefix else (self.right, self.left)
        row = np.arange(len(words))
        low, other, size = (np.full(len(words), x) for x in (0, 0, self.size))
        for k in range(exact.shape[1]):
            a = near.before(low)
            kids = near.before(low + size) - a
            c, each = exact[row, k], np.arange(len(row))
            other = other + np.cumsum(kids, axis=1)[each, c] - kids[each, c]
            low, size = near.first[c] + a[each, c], kids[each, c]
            keep = size > 0
            row, low, other, size = row[keep], low[keep], other[keep], size[keep]
        found = self._extended(far, rest, row, other, size)
        place = far.suffixes[found[1]]
        # The pattern starts at the end mark before the word, or reversed after it.
        at = np.searchsorted(self.breaks, place) if prefix is False else np.searchsorted(self.breaks, self.size - 2 - place) - 1
        return found[0], at

    def _extended(self, far: Direction, rest: np.ndarray, row: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, rank) of the words that extend an interval by ``rest`` with exactly one error."""
        length = rest.shape[1] - 1
        done = [(row[:0], row[:0])]
        pool = (row[:0],) * 4  # row, low, size, next position: one error made
        for i in range(length + 1):
            a = far.before(low)
            kids = far.before(low + size) - a
            c = rest[row, i]
            letters = kids > 0
            letters[:, : BREAK + 1] = False
            letters[np.arange(len(row)), c] = False
            j, s = np.nonzero(letters)
            new_low, new_size = far.first[s] + a[j, s], kids[j, s]
            # One letter too many; where it equals the next one, it is found behind that.
            more = [(row[j], new_low, new_size, np.full(len(j), i))]
            if i < length:
                more.append((row[j], new_low, new_size, np.full(len(j), i + 1)))
                # One letter less: the last of equal ones.
                last = np.flatnonzero(c != rest[row, i + 1])
                more.append((row[last], low[last], size[last], np.full(len(last), i + 1)))
            each = np.arange(len(row))
            low, size = far.first[c] + a[each, c], kids[each, c]
            keep = size > 0
            row, low, size = row[keep], low[keep], size[keep]
            pool = self._exactly(far, rest, tuple(np.concatenate(x) for x in zip(pool, *more)), done)
        while len(pool[0]):
            pool = self._exactly(far, rest, pool, done)
        return tuple(np.concatenate(x) for x in zip(*done))

    @staticmethod
    def _exactly(far: Direction, rest: np.ndarray, pool: tuple, done: list) -> tuple:
        """Every state takes its next symbol; those that took the end of the word go to ``done``."""
        row, low, size, at = pool
        c = rest[row, at]
        a = far.before_of(low, c)
        size = far.before_of(low + size, c) - a
        low, at = far.first[c] + a, at + 1
        end = (size > 0) & (at == rest.shape[1])
        done.append((row[end], low[end]))
        keep = (size > 0) & ~end
        return row[keep], low[keep], size[keep], at[keep]


def best_near(table: pa.Table) -> pa.Table:
    """One bucket (side, word, n, held): for every word its near words in the bucket, counted, and the best of them.

    Side 0 leaves the first half exact, side 1 the rest; what both find counts on side 0.
    """
    prefix = table.column("side")[0].as_py() == 0
    word, n, held = (table.column(c).combine_chunks() for c in ("word", "n", "held"))
    own = word.filter(held)
    index, sizes = own.to_pylist(), n.filter(held)
    asked = word.to_pylist()
    fm = Index(index, asked)
    pairs = []
    length = np.array([len(w) for w in asked])
    for size in np.unique(length).tolist():
        some = np.flatnonzero(length == size)
        for a in range(0, len(some), 4096):
            part = some[a : a + 4096]
            row, at = fm.one_error(fm.spelled([asked[i] for i in part.tolist()]), size // 2, prefix)
            pairs.append((part[row], at))
    row, at = (np.concatenate(x) for x in zip(*pairs))
    if not prefix:
        new = np.array([asked[i][: len(asked[i]) // 2] != index[j][: len(asked[i]) // 2] for i, j in zip(row.tolist(), at.tolist())], dtype=bool)
        row, at = row[new], at[new]
    found = pa.table({"row": pa.array(row), "form_n": sizes.take(pa.array(at)), "form": own.take(pa.array(at))})
    found = found.sort_by([("row", "ascending"), ("form_n", "descending"), ("form", "ascending")])
    first = np.unique(found.column("row").to_numpy(), return_index=True)[1]
    best = np.full(len(asked), -1)
    best[found.column("row").to_numpy()[first]] = first
    pick = pa.array(best, mask=best < 0)
    return pa.table({"word": word, "n": n, "n_near": pa.array(np.bincount(row, minlength=len(asked))), "form_n": found.column("form_n").take(pick), "form": found.column("form").take(pick)})


def _sides(words: DataFrame) -> DataFrame:
    """(side, key): every word with its end, and reversed."""
    return words.select(F.posexplode(F.array(F.concat("word", F.lit(END)), F.concat(F.reverse("word"), F.lit(END)))).alias("side", "key"))


def full_prefixes(words: DataFrame, most: int, step: int = 6) -> dict[tuple[int, str], str]:
    """Prefixes (side, letters) of over ``most`` words, with the letters that follow them.

    ``most`` is at least a 10 000th of all words, so each length has fewer than
    10 000 such prefixes. Lengths are counted a few at a time, until none is left.
    """
    keys, out, first = _sides(words), {}, LEAST
    while True:
        at = keys.where(F.length("key") > first).select("side", "key", F.explode(F.sequence(F.lit(first), F.least(F.lit(first + step - 1), F.length("key") - 1))).alias("d"))
        cut = at.select("side", F.expr("substring(key, 1, d)").alias("prefix"), F.expr("substring(key, d + 1, 1)").alias("next"))
        rows = cut.groupBy("side", "prefix").agg(F.count(F.lit(1)).alias("n"), F.collect_set("next").alias("next")).where(F.col("n") > most).collect()
        out |= {(r["side"], r["prefix"]): "".join(sorted(r["next"])) for r in rows}
        first += step
        deep = [(r["side"], r["prefix"]) for r in rows if len(r["prefix"]) == first - 1]
        if not deep:
            return out
        spark = words.sparkSession
        held = F.broadcast(spark.createDataFrame(deep, "side int, prefix string"))
        keys = keys.withColumn("prefix", F.substring("key", 1, first - 1)).join(held, ["side", "prefix"], "left_semi").select("side", "key")


def may_start(prefix: str, key: str) -> bool:
    """Whether a word one edit from ``key`` can start with ``prefix``."""
    n = len(prefix)
    i = next((k for k in range(min(n, len(key))) if prefix[k] != key[k]), min(n, len(key)))
    return i == n or prefix[i + 1 :] == key[i + 1 : n] or prefix[i + 1 :] == key[i : n - 1] or prefix[i:] == key[i + 1 : n + 1]


def places(side: int, key: str, exact: int, full: dict[tuple[int, str], str]) -> tuple[str, list[str]]:
    """The prefix that a word is indexed under, and all under which words are found that share its first ``exact`` letters."""
    d = LEAST
    while (side, key[:d]) in full:
        d += 1
    if d <= exact:
        return key[:d], [key[:d]]
    out, open_ = [], [key[:exact]]
    while open_:
        node = open_.pop()
        for c in full[side, node]:
            below = node + c
            if may_start(below, key):
                (open_ if (side, below) in full else out).append(below)
    return key[:d], out


def near_words(words: DataFrame, bucket_words: int = 4096) -> DataFrame:
    """(word, n, n_near, form_n, form) per row of ``words`` (word, n; different words): its near words, counted, and the
    one of largest n, smallest in code-point order among equals.

    A search leaves a prefix or a suffix of three letters or more exact, so words
    are dealt to buckets by such a prefix of the word (side 0) or of its reverse
    (side 1). Where over ``bucket_words`` words (or a 10 000th of all) share it,
    longer ones deal them; a word whose exact half is shorter asks all buckets
    that can hold a near word.
    """
    spark = words.sparkSession
    total = words.count()
    most = max(bucket_words, total // 10_000)
    parts = max(1, -(-total // most))
    shared = spark.sparkContext.broadcast(full_prefixes(words, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = shared.value
        for batch in batches:
            rows = []
            for i, word in enumerate(batch.column(0).to_pylist()):
                half = len(word) // 2
                for side, key, exact in ((0, word + END, half), (1, word[::-1] + END, len(word) - half)):
                    own, asked = places(side, key, exact, full)
                    rows += [(zlib.crc32(p.encode()) % parts * 2 + side, side, i, p == own) for p in {own, *asked}]
            # A bucket that a word is indexed in and asks for another prefix of is one row.
            merged: dict[tuple, bool] = {}
            for bucket, side, i, held in rows:
                merged[bucket, side, i] = merged.get((bucket, side, i), False) or held
            bucket, side, at = (list(x) for x in zip(*merged)) if merged else ([], [], [])
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int64()), pa.array(side, pa.int32()), batch.column(0).take(at), batch.column(1).take(at), pa.array(list(merged.values()), pa.bool_())],
                names=["bucket", "side", "word", "n", "held"],
            )

    dealt = words.select("word", "n").mapInArrow(run, "bucket long, side int, word string, n long, held boolean")
    found = dealt.groupBy("bucket").applyInArrow(lambda t: best_near(t), "word string, n long, n_near long, form_n long, form string")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))))
    out = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    return out.select("word", "n", "n_near", (-F.col("best.n")).alias("form_n"), F.col("best.form").alias("form"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) without circles: every turn doubles the steps that are taken."""
    at = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 7,
    least_uses: int = 2,
    ratio: int = 10,
    every: int = 31,
    bucket_words: int = 4096,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``least`` code points and ``least_uses`` uses or more.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; a run whose
    crc32 with its document's id is divisible by ``every`` loses a code point (a
    null id counts as the empty text). ``form`` is the near word of largest ``n``
    if that is ``ratio`` times the word's or more; ``ratio`` must be over 1, so
    forms never lead in a circle. Null and empty texts have no words; repeated
    rows count; other columns are ignored; an empty table gives no rows.
    """
    if least < 2 * LEAST or ratio < 2:
        raise ValueError(f"words need {2 * LEAST} code points and a ratio over 1")
    slim = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    words = materialize(counted(slim, least, every).where(F.col("n") >= least_uses), "vocabulary")
    near = near_words(words, bucket_words)
    formed = F.col("form_n") >= ratio * F.col("n")
    rows = materialize(near.select("word", F.when(formed, F.col("form")).alias("form"), "n", "n_near", F.when(formed, F.col("form_n")).alias("form_n")), "forms")
    links = roots(rows.where("form IS NOT NULL"))
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
