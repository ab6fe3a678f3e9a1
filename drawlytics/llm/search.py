"""Ranked lexical search: documents grouped by the mask of an item's terms they hold, masks by descending bound."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType
from pyspark.sql.window import Window

from drawlytics.llm.common import slices, whole_text
from drawlytics.plans.store import materialize

#: Bytes of a text with A-Z lower-cased and all that is no letter, digit or beyond ASCII blanked.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text looked at together, and documents scored at once.
TEXT, SCORED = 4 << 20, 256


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TERM_BYTES).split()


def _postings(docs: DataFrame, known: list[bytes]) -> DataFrame:
    """(id, n, terms, uses) per row of ``docs`` (id, text): all its terms, and the numbers and uses of the ``known`` ones."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    schema = docs.select("id").schema.add("n", "long").add("terms", ArrayType(IntegerType())).add("uses", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(shared.value)}
        for batch in (part for whole in batches for part in slices(whole, 1, TEXT)):
            found = [terms(t) for t in batch.column(1).to_pylist()]
            n = np.array([len(f) for f in found], dtype=np.int64)
            term = np.fromiter(map(number.get, chain.from_iterable(found), repeat(-1)), np.int64, int(n.sum()))
            key = (np.repeat(np.arange(len(n)), n) * len(number) + term)[term >= 0]
            key, uses = np.unique(key, return_counts=True)
            doc, term = np.divmod(key, max(1, len(number)))
            offsets = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, uses)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=schema.names)

    return docs.mapInArrow(run, schema)


class Segment:
    """Some documents: the impacts of each term's postings, and its bitmap over the documents."""

    def __init__(self, rows: pa.Table, n_docs: int, n_terms: int):
        self.ids, self.size = rows.column("id").combine_chunks(), rows.num_rows
        n = rows.column("n").to_numpy()
        lists = [rows.column(c).combine_chunks() for c in ("terms", "uses")]
        term, uses = (x.flatten().to_numpy().astype(np.int64) for x in lists)
        doc = np.repeat(np.arange(self.size), np.diff(lists[0].offsets.to_numpy()))
        length = 50 + 50 * n * n_docs // n_terms
        impact = 1_000_000_000 * uses // (1000 * uses + 20 * length[doc])
        order = np.argsort(term, kind="stable")
        term, self.doc, self.impact = term[order], doc[order], impact[order]
        self.terms, self.first = np.unique(term, return_index=True)
        self.last = np.append(self.first[1:], len(term))
        self.peak = np.maximum.reduceat(self.impact, self.first) if len(term) else self.impact
        self.bitmaps: dict[int, np.ndarray] = {}

    def bitmap(self, at: int) -> np.ndarray:
        if at not in self.bitmaps:
            holds = np.zeros(self.size, dtype=bool)
            holds[self.doc[self.first[at] : self.last[at]]] = True
            self.bitmaps[at] = np.packbits(holds)
        return self.bitmaps[at]

    def score(self, docs: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), dtype=np.int64)
        for t, w in zip(at.tolist(), weight.tolist()):
            own = self.doc[self.first[t] : self.last[t]]
            place = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            out += w * np.where(own[place] == docs, self.impact[self.first[t] + place], 0)
        return out

    def best(self, wanted: np.ndarray, weights: np.ndarray, top: list[tuple], most: int) -> list[tuple]:
        """``top`` (at most ``most`` of (-score, no id, id), in order) with the documents of this segment.

        Documents are grouped by the mask of the wanted terms they hold. A mask is
        worth at most the peaks of its terms; masks are scored by descending bound
        until none can enter ``top``, ties included.
        """
        at = np.searchsorted(self.terms, wanted)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == wanted[here]
        here &= weights > 0
        at, weight = at[here], weights[here]
        worth = weight * self.peak[at]
        if not len(at) or (len(top) == most and worth.sum() < -top[-1][0]):
            return top
        maps = np.stack([self.bitmap(t) for t in at.tolist()])
        docs = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(maps), count=self.size))
        holds = np.unpackbits(maps, axis=1, count=self.size)[:, docs]
        group, first = _groups(holds)
        bound = (worth[:, None] * holds[:, first]).sum(axis=0)[group]
        order = np.argsort(-bound, kind="stable")
        for k in range(0, len(order), SCORED):
            if len(top) == most and bound[order[k]] < -top[-1][0]:
                break
            some = np.sort(docs[order[k : k + SCORED]])
            score = self.score(some, at, weight)
            good = score >= max(1, -top[-1][0] if len(top) == most else 1)
            found = self.ids.take(pa.array(some[good])).to_pylist()
            top = sorted(chain(top, ((-s, i is None, i) for s, i in zip(score[good].tolist(), found))), key=_order)[:most]
        return top


def _order(x: tuple) -> tuple:
    return x[:2] if x[1] else x


def _groups(holds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every column, equal columns being one, and a column of each group."""
    bits = np.packbits(holds, axis=0)
    bits = np.concatenate([bits, np.zeros((-len(bits) % 8, bits.shape[1]), dtype=np.uint8)])
    masks = np.ascontiguousarray(bits.T).view(np.uint64)
    first, group = np.unique(masks[:, 0], return_index=True, return_inverse=True)[1:]
    for k in range(1, masks.shape[1]):
        own, more = np.unique(masks[:, k], return_inverse=True)
        first, group = np.unique(group * len(own) + more, return_index=True, return_inverse=True)[1:]
    return group, first


def _ranked(postings: DataFrame, items: list[tuple], weights: np.ndarray, n_docs: int, n_terms: int, most: int, item_schema: StructType) -> DataFrame:
    """(_item, item, id, score): each task's best documents of every item."""
    shared = postings.sparkSession.sparkContext.broadcast((items, weights))
    schema = StructType([*item_schema.fields]).add("_item", "long").add("id", postings.schema["id"].dataType).add("score", "long")
    size = max(1024, min(1 << 14, (1 << 29) // max(1, len(weights))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = shared.value
        top: list[list] = [[] for _ in wanted]
        held: list[pa.RecordBatch] = []
        kind = None

        def score() -> None:
            segment = Segment(pa.Table.from_batches(held), n_docs, n_terms)
            for i, (_, _, own) in enumerate(wanted):
                top[i] = segment.best(own, weight[own], top[i], most)

        for batch in batches:
            kind = batch.column(0).type
            for first in range(0, batch.num_rows, size):
                held.append(batch.slice(first, size))
                if sum(b.num_rows for b in held) >= size:
                    score()
                    held = []
        if held:
            score()
        for (item, number, _), best in zip(wanted, top):
            if best:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(best), items_type), pa.array([number] * len(best), pa.int64()), pa.array([i for _, _, i in best], kind), pa.array([-s for s, _, _ in best], pa.int64())],
                    names=schema.names,
                )

    from pyspark.sql.pandas.types import to_arrow_type

    items_type = to_arrow_type(item_schema[0].dataType)
    return postings.mapInArrow(run, schema)


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    most: int = 50,
    pass_chars: int = 4_000_000,
    salts: int = 64,
) -> DataFrame:
    """(item id, rank, id, score): the ``most`` best documents of every row of ``items`` with a score above 0.

    Scores are whole numbers: a term's weight (of its document frequency) times
    its saturated uses, over the item's different terms. Equal scores rank by id,
    null ids last. Every row of ``items`` is ranked by itself, repeated ones and
    null ids too; repeated documents are documents of their own; null and empty
    texts match nothing and are not counted. Other columns are ignored; an empty
    table on either side gives no rows. The terms of ``pass_chars`` characters of
    items are looked for at a time and broadcast by that bound; more items take
    more passes. A task keeps ``most`` documents per item.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    queries = items.select(F.col(item_id_col), whole_text(item_text_col).alias("_text"))
    item_schema = queries.select(item_id_col).schema
    queries = materialize(queries.withColumn("_row", F.monotonically_increasing_id()), "queries")
    chars = queries.agg(F.sum(F.length("_text"))).first()[0] or 0
    passes = max(1, math.ceil(chars / pass_chars))
    out = None
    for k in range(passes):
        rows = queries.where((F.pmod(F.xxhash64("_row"), F.lit(passes)) == k) & (F.col("_text") != "")).collect()
        held = [(r[0], r["_row"], set(terms(r["_text"]))) for r in rows]
        known = sorted(set().union(*(t for _, _, t in held)))
        if not known:
            continue
        number = {t: i for i, t in enumerate(known)}
        wanted = [(i, row, np.array(sorted(number[t] for t in own), dtype=np.int64)) for i, row, own in held]
        postings = materialize(_postings(slim, known), "postings")
        n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            break
        matched = postings.where(F.size("terms") > 0)
        counts = matched.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
        weights = np.zeros(len(known), dtype=np.int64)
        for term, df in zip(counts.column("term").to_pylist(), counts.column("df").to_pylist()):
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        part = _ranked(matched, wanted, weights, n_docs, n_terms, most, item_schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        schema = StructType([*item_schema.fields]).add("rank", "integer").add(id_col, docs.schema[id_col].dataType).add("score", "long")
        return spark.createDataFrame([], schema)
    best = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    # Each task sends its best: those of one item meet in parts first.
    salted = Window.partitionBy("_item", "_salt").orderBy(*best)
    few = out.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts))).withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= most)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(*best))).where(F.col("rank") <= most)
    return ranked.select(item_id_col, "rank", F.col("id").alias(id_col), "score")
