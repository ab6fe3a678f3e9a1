"""Continuous ingest of draw files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from drawlytics.functions.columns import parse_draw_date, whole_number
from drawlytics.operators.ingest import dedupe_draws, missing_draws, split_valid
from drawlytics.params import GAME, Game
from drawlytics.plans.index import SERIES
from drawlytics.plans.store import materialize
from drawlytics.sources.versioned import file_system as _fs

DRAW_SCHEMA = (
    "series string, draw_id bigint, draw_date date, n1 int, n2 int, n3 int, n4 int, n5 int, chance int"
)


def text_schema(game: Game = GAME) -> str:
    balls = ", ".join(f"`Numéro {i}` string" for i in range(1, game.main_pick + 1))
    return f"series string, draw_id string, Jour string, Date string, {balls}, Chance string"


def parse_text(raw: DataFrame, game: Game = GAME) -> DataFrame:
    return raw.select(
        "series",
        whole_id("draw_id", game).alias("draw_id"),
        parse_draw_date("Date").alias("draw_date"),
        *[whole_number(f"`Numéro {i}`").alias(c) for i, c in enumerate(game.ball_cols, 1)],
        whole_number("Chance").alias("chance"),
    )


def whole_id(c: str, game: Game = GAME):
    """Given id, else a hash of the whole row: different draws have different ids."""
    fields = ["series", "Date", *[f"`Numéro {i}`" for i in range(1, game.main_pick + 1)], "Chance"]
    text = F.to_json(F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))
    return F.coalesce(F.col(c).try_cast("bigint"), F.xxhash64(text))


def start_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Run ``handle(batch, batch_id)`` over everything available, then stop."""
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def read_draws(spark: SparkSession, out_dir: str) -> DataFrame:
    """All draws ingested so far."""
    return spark.read.schema(DRAW_SCHEMA + ", batch bigint").parquet(f"{out_dir}/draws").drop("batch")


def start_ingest(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    game: Game = GAME,
    series_cols: Sequence[str] = SERIES,
    files_per_batch: int = 1,
) -> StreamingQuery:
    """New text files -> parse -> validate -> one row per (series, date) -> append.

    A draw of any age is accepted, so there is no watermark: rows whose date is
    stored already are dropped by an anti-join against the stored draws of the
    batch's date range. Every batch owns one directory and overwrites it, and
    ignores it when looking up stored draws, so a retried batch changes nothing."""
    raw = (
        spark.readStream.schema(text_schema(game))
        .options(header=True, maxFilesPerTrigger=files_per_batch)
        .csv(in_dir)
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Parsed once: the batch is read for the quarantine, its date range and the append.
        good, bad = split_valid(materialize(parse_text(batch, game), "stream-parsed"), game)
        bad.write.mode("overwrite").parquet(f"{out_dir}/quarantine/batch={batch_id}")
        fresh = dedupe_draws(good, series_cols)
        if exists(batch.sparkSession, f"{out_dir}/draws"):
            lo, hi = good.agg(F.min("draw_date"), F.max("draw_date")).first()
            stored = (
                batch.sparkSession.read.schema(DRAW_SCHEMA + ", batch bigint")
                .parquet(f"{out_dir}/draws")
                .where((F.col("batch") != batch_id) & F.col("draw_date").between(lo, hi))
            )
            fresh = missing_draws(fresh, stored, series_cols)
        fresh.write.mode("overwrite").parquet(f"{out_dir}/draws/batch={batch_id}")

    return start_batches(raw, handle, checkpoint)


def draw_stream(spark: SparkSession, in_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Stored draws as a stream, in the layout :func:`start_ingest` writes or any
    directory of draw files."""
    reader = spark.readStream.schema(DRAW_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.option("recursiveFileLookup", True).parquet(in_dir)
