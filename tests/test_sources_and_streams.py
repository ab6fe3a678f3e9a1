"""Text, pages, versioned histories and streams."""

import math

import pytest
from pyspark.sql import Window as W, functions as F

from drawlytics.catalog import inputs
from drawlytics.operators import gaps, ingest, models
from drawlytics.plans.index import draw_index, occurrences
from drawlytics.operators.freq import number_freq, window_freq
from drawlytics.functions.columns import erfc
from drawlytics.sources import history, text, versioned
from drawlytics.streaming import ingest as sin
from drawlytics.streaming import state as sst

BALLS = ["n1", "n2", "n3", "n4", "n5"]
DRAW = ["series", "draw_id", "draw_date", *BALLS, "chance"]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("sep", [",", ";"])
def test_csv_round_trip(spark, sf_dir, tmp_path, sep):
    draws = inputs.draws(spark, sf_dir)
    path = str(tmp_path / "csv")
    history.write_draws_csv(draws, path, sep)
    assert rows(text.read_draws_csv(spark, path), "draw_date", *BALLS, "chance") == rows(draws, "draw_date", *BALLS, "chance")


def test_csv_needs_its_columns(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    (tmp_path / "x.csv").write_text("Date,Numéro 1\n01/01/2020,3\n", encoding="utf-8")
    with pytest.raises(ValueError):
        text.read_draws_csv(spark, path)


def test_history_versions(spark, sf_dir, tmp_path):
    base = str(tmp_path / "h")
    draws = inputs.draws(spark, sf_dir)
    assert history.write_history(draws.limit(3), base) == 1
    assert history.write_history(draws, base) == 2
    with pytest.raises(ValueError):
        history.write_history(draws.where("false"), base)
    assert history.history_versions(spark, base) == [1, 2]
    assert history.read_history(spark, base, 1).count() == 3
    assert history.read_history(spark, base).count() == draws.count()


def _files(spark, draws, path, bounds):
    """One file per id range, in the given order."""
    for lo, hi in bounds:
        part = draws.where((F.col("draw_idx") >= lo) & (F.col("draw_idx") < hi))
        part.select(*DRAW).coalesce(1).write.mode("append").parquet(path)


def test_streams_equal_batch_over_two_starts(spark, idx, tmp_path):
    """Files arrive out of order and in two runs from the same checkpoint."""
    src = str(tmp_path / "in")
    n = idx.count()
    starts = {
        "freq": lambda d: sst.start_freq(spark, src, f"{d}/t", f"{d}/ck", files_per_batch=1),
        "gaps": lambda d: sst.start_gaps(spark, src, f"{d}/t", f"{d}/ck", files_per_batch=1),
        "last": lambda d: sst.start_last_draws(spark, src, f"{d}/t", f"{d}/ck", 100, files_per_batch=1),
    }
    for bounds in ([(0, 150), (200, 260)], [(150, 200), (260, n)]):
        _files(spark, idx, src, bounds)
        for name, start in starts.items():
            start(str(tmp_path / name)).awaitTermination()
    full = draw_index(idx.select(*DRAW))
    got = sst.read_freq(spark, f"{tmp_path}/freq/t")
    assert rows(got, "pool", "num", "cnt") == rows(number_freq(occurrences(full)), "pool", "num", "cnt")
    got = sst.read_gaps(spark, f"{tmp_path}/gaps/t")
    assert rows(got, "pool", "num", "gap") == rows(gaps.current_gap(full), "pool", "num", "gap")
    got = sst.read_last_freq(spark, f"{tmp_path}/last/t")
    assert rows(got, "pool", "num", "cnt") == rows(window_freq(full, 100), "pool", "num", "cnt")


def test_ingest_accepts_late_and_repeated_files(spark, idx, tmp_path):
    one = inputs.stored(ingest.dedupe_draws(idx), "one")
    shown = one.select(
        "series", "draw_id", F.lit("").alias("Jour"), F.date_format("draw_date", "dd/MM/yyyy").alias("Date"),
        *[F.col(c).alias(f"Numéro {c[1:]}") for c in BALLS], F.col("chance").alias("Chance"), "draw_idx",
    )
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for lo, hi in [(100, 500), (100, 300), (0, 100)]:
        part = shown.where((F.col("draw_idx") >= lo) & (F.col("draw_idx") < hi)).drop("draw_idx")
        part.coalesce(1).write.mode("append").options(header=True).csv(src)
        sin.start_ingest(spark, src, out, f"{tmp_path}/ck").awaitTermination()
    assert rows(sin.read_draws(spark, out), *DRAW) == rows(one, *DRAW)


def written(spark, base, version):
    """Months a version wrote itself."""
    return sorted(p for p, v in versioned.partitions(spark, f"{base}", version).items() if v == version)


def test_merge_writes_only_the_months_it_touches(spark, sf_dir, tmp_path):
    """Old versions stay readable, known dates and repeated rows change nothing."""
    base = str(tmp_path / "h")
    draws = ingest.dedupe_draws(inputs.draws(spark, sf_dir))
    late = F.date_trunc("month", "draw_date") == F.lit("1995-03-01").cast("timestamp")
    first = history.write_history(draws.where(~late), base)
    n = draws.where(~late).count()
    assert history.merge_history(draws.where(~late).limit(40), base) is None
    second = history.merge_history(draws.where(late).unionByName(draws.where(late)).unionByName(draws.limit(3)), base)
    assert (first, second) == (1, 2) and written(spark, base, 2) == [199503]
    assert rows(history.read_history(spark, base), *DRAW) == rows(draws, *DRAW)
    assert history.read_history(spark, base, 1).count() == n < draws.count()
    # A merge that was cut off before its list was published is no version.
    (tmp_path / "h" / "data" / "v=3" / "part=199503").mkdir(parents=True)
    assert history.history_versions(spark, base) == [1, 2]
    with pytest.raises(FileNotFoundError):
        history.read_history(spark, base, 3)


def test_a_repeated_and_a_late_file_touch_their_own_month(spark, idx, tmp_path):
    """Counts and gaps: the late month is written, every other stays; a file that comes again changes nothing."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows_ = idx.select(*DRAW)
    in_month = F.date_trunc("month", "draw_date") == F.lit("1995-03-01").cast("timestamp")
    rows_.where(~in_month).coalesce(1).write.mode("append").parquet(src)
    rows_.where(in_month).coalesce(1).write.mode("append").parquet(src)
    rows_.where(in_month).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        sst.start_days(spark, src, f"{out}/t", f"{out}/ck", files_per_batch=1).awaitTermination()
    assert [written(spark, f"{out}/t", v) for v in (2, 3)] == [[199503], [199503]]
    # The one series is spread over the tasks by its days.
    state = spark.read.format("statestore").load(f"{out}/ck")
    assert idx.select("series").distinct().count() == 1 and state.select("partition_id").distinct().count() == 8
    want = gaps.current_gap(idx)
    assert rows(sst.read_gaps(spark, f"{out}/t"), "pool", "num", "gap") == rows(want, "pool", "num", "gap")
    assert rows(sst.read_freq(spark, f"{out}/t"), "pool", "num", "cnt") == rows(number_freq(occurrences(idx)), "pool", "num", "cnt")


@pytest.mark.parametrize("most", [1, 7, 10**6])
def test_newest_draws(spark, series_idx, most):
    """Against a window; repeated draws once, missing dates last; no window in the plan."""
    draws = series_idx.select(*DRAW).withColumn("draw_date", F.when(F.col("draw_id") % 50 > 0, F.col("draw_date")))
    got = sst.newest(draws.unionByName(draws).repartition(20), most)
    order = W.partitionBy("series").orderBy(F.desc("draw_date"), F.desc("draw_id"))
    want = draws.withColumn("age", F.row_number().over(order)).where(F.col("age") <= most)
    assert sorted(map(str, got.select(*DRAW).collect())) == sorted(map(str, want.select(*DRAW).collect()))
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert sst.newest(draws.where("false"), most).collect() == []


def test_erfc(spark):
    xs = [0.0, 1e-9, 0.01, 0.5, 1.0, 2.0, 2.499, 2.5, 2.6, 4.0, 9.0, 26.0, 30.0, -0.3, -3.0]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", erfc("x").alias("y"), erfc(F.lit(None).cast("double")).alias("n")).orderBy("i").collect()
    for x, r in zip(xs, got):
        assert r["y"] == pytest.approx(math.erfc(x), abs=1e-14, rel=1e-11 if x > 2.5 else None) and r["n"] is None


def test_refit_only_on_news(spark, tmp_path, monkeypatch):
    fitted = []
    monkeypatch.setattr(models, "train_and_save", lambda *a, **k: fitted.append(1) or {
        "version": 1, "n": 1, "subset_accuracy": 0.0, "f1_micro": 0.0, "top_hits": 0.0, "duration": 0.0})
    schema = "series string, draw_id long, draw_date date, n1 int"
    old = spark.createDataFrame([("a", 1, None, 1)], schema).withColumn("draw_date", F.lit("2020-01-01").cast("date"))
    later = old.withColumn("draw_date", F.lit("2020-01-03").cast("date"))
    assert models.refit_on_new(old, old, "x", str(tmp_path / "m")) is None
    assert models.refit_on_new(old, later, "x", str(tmp_path / "m")).count() == 2
    assert fitted == [1]


def test_intermediates_go_to_the_configured_folder(spark, tmp_path, monkeypatch):
    from drawlytics.plans import store

    class Conf:
        def get(self, key, default=None):
            return {"spark.checkpoint.dir": str(tmp_path)}.get(key, default)

    class Session:
        conf = Conf()

    assert store.checkpoint_root(Session()) == str(tmp_path)


def test_intermediates_need_a_shared_folder_on_a_cluster():
    from drawlytics.plans import store

    class Empty:
        def isDefined(self):
            return False

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(Empty)})

    session = type("X", (), {"conf": type("C", (), {"get": staticmethod(lambda k, d=None: d)}), "sparkContext": Context})
    with pytest.raises(RuntimeError):
        store.checkpoint_root(session)
