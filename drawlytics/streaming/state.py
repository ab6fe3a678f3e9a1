"""Running counts, gaps, count windows and refits over a stream of draws.

Counts and gaps share one keyed state: a key is one day of one series, so the
days of a dominating series spread over all tasks, a file that comes twice
changes nothing, and a late draw touches its own day. A micro-batch publishes
the summaries of the days it changed, rewriting their months only; readers merge
one row per day and number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from drawlytics.operators.freq import number_freq
from drawlytics.operators.models import refit_on_new
from drawlytics.params import CHANCE, GAME, MAIN, Game
from drawlytics.plans.index import SERIES, domain_array, draw_index, occurrences
from drawlytics.sources import versioned
from drawlytics.sources.history import history_versions, merge_history, month, read_history
from drawlytics.sources.versioned import file_system as _fs
from drawlytics.streaming.ingest import draw_stream, exists, start_batches

#: Stands for a missing date: before all others.
NO_DAY = "0001-01-01"
#: Pool of the row that stands for a day itself.
DAY = "day"
#: Tasks whose newest draws are merged first.
MERGED_TASKS = 32


def _day_rows(game: Game, k: list[str]):
    """State update of a day: its draws by id, first one kept, and a summary row per number (and one without, for the days' sizes)."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ids, cells = (list(x) for x in state.get) if state.exists else ([], [])
        width = game.main_pick + 1
        known = dict(zip(ids, (cells[i : i + width] for i in range(0, len(cells), width))))
        for frame in frames:
            values = frame[[*game.ball_cols, "chance"]].fillna(0).astype("int64").to_numpy().tolist()
            for own, row in zip(frame["draw_id"].tolist(), values):
                known.setdefault(own, row)
        ids = sorted(known)
        state.update((ids, [c for i in ids for c in known[i]]))
        uses, last = Counter(), {}
        for at, own in enumerate(ids):
            row = known[own]
            for pool, num in [*((MAIN, n) for n in row[:-1]), (CHANCE, row[-1])]:
                if num:
                    uses[pool, num] += 1
                    last[pool, num] = at
        rows = [(DAY, 0, 0, 0), *((pool, num, n, len(ids) - 1 - last[pool, num]) for (pool, num), n in uses.items())]
        out = pd.DataFrame(rows, columns=["pool", "num", "cnt", "after"])
        for name, value in zip([*k, "day"], key):
            out[name] = [value] * len(out)
        yield out.assign(n=len(ids))[[*k, "day", "n", "pool", "num", "cnt", "after"]]

    return update


def start_days(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """``k, day, n, pool, num, cnt, after`` per day of a series and number drawn on it, as draws arrive.

    ``n`` draws of the day, ``cnt`` uses of the number, ``after`` draws of the day
    behind the last with it; a row of the pool "day" stands for the day itself.
    The table is versioned by batch: a batch reads and writes the months of its days."""
    k = list(series_cols)
    draws = draw_stream(spark, in_dir, files_per_batch).withColumn("day", F.coalesce("draw_date", F.lit(NO_DAY).cast("date")))
    fields = [draws.schema[c] for c in [*k, "day"]]
    out = StructType([*fields, StructField("n", LongType())]).add("pool", "string").add("num", "integer").add("cnt", "long").add("after", "long")
    kept = StructType().add("ids", ArrayType(LongType())).add("cells", ArrayType(IntegerType()))
    days = draws.groupBy(*k, "day").applyInPandasWithState(_day_rows(game, k), out, kept, "update", "NoTimeout")

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch.persist()
        try:
            rows = batch.withColumn("part", month("day"))
            months = [r["part"] for r in rows.select("part").distinct().collect()]
            if not months:
                return
            old = versioned.read(session, out_dir, batch_id, months)
            if old is not None:
                same = old.join(batch.select(*k, "day").distinct(), [*k, "day"], "left_anti")
                rows = rows.unionByName(same.withColumn("part", month("day")))
            versioned.publish(rows, out_dir, batch_id + 1)
        finally:
            batch.unpersist()

    return (
        days.writeStream.outputMode("update")
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_freq(*args, **named) -> StreamingQuery:
    """Running counts per number: :func:`start_days`, read by :func:`read_freq`."""
    return start_days(*args, **named)


def start_gaps(*args, **named) -> StreamingQuery:
    """Current gap per number: :func:`start_days`, read by :func:`read_gaps`."""
    return start_days(*args, **named)


def read_freq(spark: SparkSession, out_dir: str, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, pool, num, cnt`` over all days so far."""
    return versioned.read(spark, out_dir).where(F.col("pool") != DAY).groupBy(*series_cols, "pool", "num").agg(F.sum("cnt").alias("cnt"))


def read_gaps(spark: SparkSession, out_dir: str, game: Game = GAME, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """``k, pool, num, gap``: draws since the last one with the number, all draws if there is none.

    The last day with a number is found map-side; behind it count its own later
    draws and those of later days, a running sum over the days of a series."""
    k = list(series_cols)
    days = versioned.read(spark, out_dir)
    sizes = days.where(F.col("pool") == DAY).select(*k, "day", "n")
    later = W.partitionBy(*k).orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)
    behind = sizes.withColumn("later", F.coalesce(F.sum("n").over(later), F.lit(0))).drop("n")
    last = days.where(F.col("pool") != DAY).groupBy(*k, "pool", "num").agg(F.max(F.struct("day", "after")).alias("last"))
    last = last.select(*k, "pool", "num", F.col("last.day").alias("day"), F.col("last.after").alias("after")).join(behind, [*k, "day"])
    grid = sizes.groupBy(*k).agg(F.sum("n").alias("n")).select(*k, "n", F.inline(domain_array(game)))
    gap = F.coalesce(F.col("later") + F.col("after"), F.col("n"))
    return grid.join(last, [*k, "pool", "num"], "left").select(*k, "pool", "num", gap.alias("gap"))


def _state_before(spark: SparkSession, out_dir: str, batch_id: int) -> DataFrame | None:
    fs, base = _fs(spark, out_dir)
    if not fs.exists(base):
        return None
    ids = []
    for status in fs.listStatus(base):
        name = status.getPath().getName()
        if name.startswith("batch=") and exists(spark, f"{out_dir}/{name}/_SUCCESS"):
            ids.append(int(name[6:]))
    older = [i for i in ids if i < batch_id]
    return spark.read.parquet(f"{out_dir}/batch={max(older)}") if older else None


def read_state(spark: SparkSession, out_dir: str) -> DataFrame | None:
    return _state_before(spark, out_dir, 1 << 62)


def newest_rows(table: pa.Table, k: list[str], most: int) -> pa.Table:
    """The ``most`` newest draws of each series of a table, each draw once."""
    table = table.sort_by([*((c, "ascending") for c in k), ("draw_date", "descending"), ("draw_id", "descending")]).combine_chunks()
    if not table.num_rows:
        return table

    def changes(names: list[str]) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for c in names:
            own = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= own[1:] != own[:-1]
        return new

    first, differs = changes(k), changes([*k, "draw_date", "draw_id"])
    rank = np.cumsum(differs)
    start = rank[first][np.cumsum(first) - 1]
    return table.filter(pa.array(differs & (rank - start < most)))


def newest(draws: DataFrame, most: int, series_cols: Sequence[str] = SERIES) -> DataFrame:
    """The ``most`` newest draws per series, by (date, id), each once.

    A bounded aggregate that merges: a task keeps the newest of what it reads,
    then those of a few tasks meet, then those of a series. No task ever sorts a series."""
    k = list(series_cols)
    plain = draws.schema
    tagged = StructType([*plain.fields]).add("_task", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            held = newest_rows(own if held is None else pa.concat_tables([held, own]), k, most)
        if held is not None:
            task = TaskContext.get().partitionId() // MERGED_TASKS
            yield from held.append_column("_task", pa.array(np.full(held.num_rows, task), pa.int32())).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        return newest_rows(table, k, most)

    few = draws.mapInArrow(run, tagged).groupBy(*k, "_task").applyInArrow(lambda t: merge(t), tagged)
    return few.drop("_task").groupBy(*k).applyInArrow(lambda t: merge(t), plain)


def start_last_draws(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    window: int,
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """The last ``window`` draws per series. Keeping the newest draws of state
    and batch together is exact for late and repeated draws too."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        old = _state_before(batch.sparkSession, out_dir, batch_id)
        rows = batch if old is None else old.unionByName(batch)
        newest(rows, window, series_cols).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return start_batches(draw_stream(spark, in_dir, files_per_batch), handle, checkpoint)


def read_last_freq(
    spark: SparkSession, out_dir: str, game: Game = GAME, series_cols: Sequence[str] = SERIES
) -> DataFrame:
    """:func:`number_freq` over the window kept by :func:`start_last_draws`."""
    return number_freq(occurrences(draw_index(read_state(spark, out_dir), series_cols), game, series_cols), series_cols)


def start_refit(
    spark: SparkSession,
    in_dir: str,
    history_dir: str,
    models_dir: str,
    metrics_dir: str,
    checkpoint: str,
    series_cols: Sequence[str] = SERIES,
    files_per_batch: int | None = None,
    **fit,
) -> StreamingQuery:
    """Merge every batch into the versioned history and refit the models when it
    brought new draws; batches without news do nothing."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if batch.isEmpty():
            return
        if history_versions(session, history_dir):
            history = read_history(session, history_dir)
        else:
            history = session.createDataFrame([], batch.schema)
        # Fitted on the union, which is never written: only the months of the new draws are.
        if refit_on_new(history, batch, models_dir, metrics_dir, series_cols, **fit) is not None:
            merge_history(batch, history_dir, series_cols)

    return start_batches(draw_stream(spark, in_dir, files_per_batch), handle, checkpoint)
