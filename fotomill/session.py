"""Session helpers: table access, checkpoint folder, hot-key joins."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "fotomill", master: str = "local[8]", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under; a cluster brings its own."""
    b = SparkSession.builder.master(master).appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir. A local session without one gets a temporary folder; on a cluster, whose executors
    do not share such a folder, its absence is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="fotomill-cp-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there: survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_measure(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """cut_lineage(), and aggregates of the rows taken while they are written: no job of their own, no second pass."""
    seen = Observation()
    return cut_lineage(df.observe(seen, *[c.alias(k) for k, c in metrics.items()])), seen.get


#: A lookup table of at most so many rows (of a few short columns, a few megabytes) is broadcast.
BROADCAST_ROWS = 20_000


def lookup(big: DataFrame, small: DataFrame, key: str, spread: Column, total: int, small_rows: int) -> DataFrame:
    """Left equi-join of `big` with `small` (unique keys), where one key may hold a third of `big`.

    small_rows: an upper bound of the rows of `small`, counted by the caller. Up to BROADCAST_ROWS of them are broadcast, and the keys don't
    matter; beyond, the join is a sort-merge join with hot keys split over many tasks.
    """
    if small_rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, "left")
    counts = big.groupBy(key).agg(F.count("*").alias("__n"))
    sized = small.join(counts, key, "left")
    return hot_split_join(big, sized, [key], "__n", total, spread, "left")


def hot_split_join(
    big: DataFrame,
    small: DataFrame,
    key: str | list[str],
    count_col: str,
    total: int,
    spread: Column,
    how: str = "inner",
    counts: DataFrame | None = None,
    parts: int = 500,
) -> DataFrame:
    """Equi-join of `big` with `small` (unique keys); `count_col` of `counts` (default: of `small`) says how many rows of `big` have a key.

    Keys held by more than a `parts`-th of `total` rows are `parts` at most, whatever the size; these key values alone are
    broadcast, each with the number of tasks that makes its share as small as that of others. Their rows are spread over
    so many tasks by `spread`, and their rows of `small` repeated as often; every other key meets in one task. `small` is never
    broadcast. `count_col` is dropped. Null keys meet nothing. how: "inner" or "left".
    """
    keys, s, hot_at = [key] if isinstance(key, str) else key, "__salt", max(1000, total // parts)
    hot_keys = (small if counts is None else counts).filter(F.col(count_col) > hot_at)
    hot_keys = hot_keys.select(*keys, F.ceil(F.col(count_col) / hot_at).cast("int").alias("__tasks"))
    tasks = F.coalesce("__tasks", F.lit(1))
    left = big.join(F.broadcast(hot_keys), keys, "left").withColumn(s, F.pmod(F.xxhash64(spread), tasks).cast("int")).drop("__tasks")
    right = small.join(F.broadcast(hot_keys), keys, "left").withColumn(s, F.explode(F.sequence(F.lit(0), tasks - 1))).drop(count_col, "__tasks")
    return left.join(right.hint("merge"), [*keys, s], how).drop(s)
