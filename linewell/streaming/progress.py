"""Search of a stored lines table that can be watched while it runs.

The table is streamed a few files at a time.  Each step writes its matches and, from
metrics observed in the same pass, a row of progress; a step that runs again replaces
both.  What is done stays done: a search that was stopped goes on from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linewell.functions.patterns import Term, as_term, check_pattern, line_matches

STEP = "step bigint, lines bigint, matches bigint, total bigint"


def search_with_progress(
    spark: SparkSession, table: str, pattern: Term | str, out: str, files_per_step: int = 64, **options
) -> StreamingQuery:
    """Start a search of the lines table in ``table``; the query ends when all of it is searched.

    Matches go to ``out/matches``, progress to ``out/progress`` (see ``progress_of``).  The
    number of all lines comes from the files' footers.
    """
    term = as_term(pattern, **options)
    check_pattern(spark, term)
    stored = spark.read.parquet(table)
    total = stored.count()

    def step(batch: DataFrame, number: int) -> None:
        seen = Observation()
        hit = line_matches("line", term)
        watched = batch.observe(seen, F.count("*").alias("lines"), F.count_if(hit).alias("matches"))
        watched.filter(hit).write.mode("overwrite").parquet(f"{out}/matches/step={number}")
        row = [(number, seen.get["lines"], seen.get["matches"], total)]
        batch.sparkSession.createDataFrame(row, STEP).coalesce(1).write.mode("overwrite").parquet(f"{out}/progress/step={number}")

    lines = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", files_per_step).parquet(table)
    return lines.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/checkpoint").trigger(
        availableNow=True).start()


def progress_of(spark: SparkSession, out: str) -> DataFrame:
    """A row for each step so far: step, and the lines, matches and percent of all lines up to it."""
    so_far = Window.orderBy("step")  # a few rows: one a step
    steps = spark.read.schema(STEP).parquet(f"{out}/progress")
    lines = F.sum("lines").over(so_far)
    return steps.select(
        "step", lines.alias("n_lines"), F.sum("matches").over(so_far).alias("n_matches"),
        F.when(F.col("total") > 0, F.floor(100 * lines / F.col("total"))).otherwise(F.lit(100)).cast("int").alias("percent"))
