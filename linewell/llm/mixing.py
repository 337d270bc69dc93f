"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

For each source, document rates r are sought that stay as close as possible to 1
(least sum of r ln r - r) while the words they take meet the source's target and no
rate passes ``MOST``.  The convex dual has one unknown a source; its solution tilts
exponentially, r = min(MOST, exp(lambda * size / mean size)).  Newton steps run on a
histogram (source, size, documents), which is all that the dual needs; each step is
one grouped sum, kept inside a bracket that halves when a step would leave it.

Rates become copies by systematic rounding along (source, size): the running sum of
the rows' rates is cut at whole numbers, also inside rows of one id.  Because sizes rise along that order, a source misses
its target by less than twice its largest document, and by far less after the best of
PHASES starts is taken.  Sums are exact (decimals and
integers), so reruns agree to the last copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewell.llm._common import n_words
from linewell.sources.shared import checkpointed

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
ROUNDS, STEPS, TOLERANCE = 25, 3, 1e-10
#: Share of a target (and one word at least) that a tilt may miss when the steps end.
MISSED = 1e-6
#: Rates are counted in units of 1 / UNIT; documents of one size are rounded in runs of about RUN.
UNIT, RUN, PHASES = 1 << 30, 1 << 12, 32


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), source))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    Weights repeat along the sources' code-point order, null last.  ``share`` times all
    words is dealt by weight; a target stops at ``most`` times its source and the
    excess goes to the others by weight (share must not pass most).
    """
    every = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("_weight", weight).withColumn("_cap", F.lit(most) * F.col("source_size"))
    filling = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    after = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after)
    leveled = ranked.withColumn("_level", level)
    fits = F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))
    return leveled.withColumn("_at", F.first(fits, ignorenulls=True).over(whole)).withColumn(
        "target", F.coalesce(F.least("_cap", F.col("_at") * F.col("_weight")), "_cap"),
    ).drop("_weight", "_cap", "_level", "_at")


def _exact(x: Column) -> Column:
    """A sum that no order of adding changes."""
    return F.sum(x.cast("decimal(38,6)")).cast("double")


def tilts(histogram: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """``goals`` (key, source_size, target) with ``_scale`` and ``_tilt`` (lambda), by Newton steps.

    A source whose target is ``most`` times its size has no finite solution; its tilt
    is null and means the greatest rate.  So has one without words.  A source that the
    steps leave off its target by more than ``MISSED`` is an error.
    """
    means = histogram.filter("size > 0").groupBy("key").agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("_scale"))
    solvable = (F.col("source_size") > 0) & (F.col("target") < most * F.col("source_size")) & (F.col("target") > 0)
    state = goals.filter(solvable).join(means, "key").select(
        "key", "target", "_scale", F.log(F.col("target") / F.col("source_size")).alias("_tilt"),
        F.lit(-1e6).alias("_low"), F.lit(1e6).alias("_high"), F.lit(1.0).alias("_miss"))
    used = histogram.filter("size > 0")

    def step(state: DataFrame) -> DataFrame:
        x = F.col("size") / F.col("_scale")
        rate = F.least(F.lit(most), F.exp(F.least(F.col("_tilt") * x, F.lit(50.0))))
        sums = used.join(state, "key").groupBy("key").agg(
            _exact(F.col("n") * F.col("size") * rate).alias("_got"),
            _exact(F.when(rate < most, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("_slope"))
        gap = F.col("_got") - F.col("target")
        low = F.when(gap <= 0, F.col("_tilt")).otherwise(F.col("_low"))
        high = F.when(gap >= 0, F.col("_tilt")).otherwise(F.col("_high"))
        newton = F.when(F.col("_slope") > 0, F.col("_tilt") - gap / F.col("_slope"))
        done = F.col("_miss") <= TOLERANCE
        return state.join(sums, "key").withColumn("_miss", F.abs(gap) / F.col("target")).withColumns(
            {"_lower": low, "_higher": high}).withColumn(
            "_next", F.when((newton > F.col("_lower")) & (newton < F.col("_higher")), newton)
            .otherwise((F.col("_lower") + F.col("_higher")) / 2)).select(
            "key", "target", "_scale", F.when(done, F.col("_tilt")).otherwise(F.col("_next")).alias("_tilt"),
            F.col("_lower").alias("_low"), F.col("_higher").alias("_high"), "_miss")

    for _ in range(ROUNDS):
        for _ in range(STEPS):
            state = step(state)
        state = checkpointed(state)
        if (state.agg(F.max("_miss")).first()[0] or 0.0) <= TOLERANCE:
            break
    else:
        off = F.col("_miss") > F.greatest(F.lit(MISSED), 1 / F.col("target"))
        if wrong := state.filter(off).orderBy(F.desc("_miss")).select("key", "_miss").first():
            raise ArithmeticError(f"the tilt of source {wrong['key']} still misses its target by {wrong['_miss']:.1e} of it")
    return goals.join(state.select("key", "_scale", "_tilt"), "key", "left")


def _decided(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """id, key, size, rows, source_size, target, base, more: of the equal rows ``more`` get base + 1 copies, the rest base."""
    narrow = checkpointed(docs.select(
        F.col(doc_id).alias("id"), F.col(source).alias("source"),
        _source_key(F.col(source)).alias("key"), n_words(F.col(text)).alias("size")))
    histogram = checkpointed(narrow.groupBy("key", "source", "size").agg(F.count("*").alias("n")))
    goals = checkpointed(targets(histogram.groupBy("key", "source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"))))
    tilted = tilts(histogram, goals.select("key", "source_size", "target"))

    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(
        F.col("_tilt").isNull(), F.when(F.col("target") > 0, F.lit(MOST)).otherwise(0.0)).otherwise(
        F.least(F.lit(MOST), F.exp(F.least(F.col("_tilt") * F.col("size") / F.col("_scale"), F.lit(50.0)))))
    rates = histogram.join(tilted, "key").select(
        "key", "size", "source_size", "target", F.round(rate * UNIT).cast("long").alias("_rate"),
        F.expr(f"cast(n div {RUN} + 1 as int)").alias("_runs"))

    units = narrow.groupBy("id", "key", "size").agg(F.count("*").alias("rows"))
    placed = checkpointed(units.join(rates, ["key", "size"]).withColumn(
        "_run", F.pmod(F.xxhash64("id"), F.col("_runs"))))
    runs = placed.groupBy("key", "size", "_run").agg(
        F.sum("rows").alias("_n"), F.max("_rate").alias("_rate"))
    sizes = runs.groupBy("key", "size").agg(
        F.sum(F.pmod(F.col("_n") * F.col("_rate"), F.lit(UNIT))).alias("_sum"))
    along = Window.partitionBy("key").orderBy("size")
    sizes = sizes.select("key", "size", (F.sum("_sum").over(along) - F.col("_sum")).alias("_before"))
    inside = Window.partitionBy("key", "size").orderBy("_run")
    add = F.pmod(F.col("_n") * F.col("_rate"), F.lit(UNIT))
    phases = runs.withColumn("_in", F.sum(add).over(inside) - add).join(sizes, ["key", "size"]).select(
        "key", "size", "_run", F.pmod(
            F.col("_before") + F.col("_in"), F.lit(UNIT)).alias("_phase"))
    order = Window.partitionBy("key", "size", "_run").orderBy(F.xxhash64("id"), "id")
    # _j: rows up to the unit's last one.
    so_far = F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ordered = checkpointed(placed.withColumn("_j", so_far).join(phases, ["key", "size", "_run"]))

    def copies(start: str) -> str:
        last = f"(_phase + {start} + _j * _rate)"
        return f"({last} div {UNIT} - ({last} - rows * _rate) div {UNIT})"

    # Any start of the running sum is fair; the one that comes nearest to the target is taken.
    starts = [UNIT // PHASES * k for k in range(PHASES)]
    tried = ordered.groupBy("key").agg(F.max("target").alias("_goal"), *[
        F.sum(F.expr(f"{copies(str(s))} * size")).alias(f"_s{s}") for s in starts])
    best = tried.select("key", F.array_min(F.array(*[F.struct(
        F.abs(F.col(f"_s{s}") - F.col("_goal")).alias("off"), F.lit(s).cast("long").alias("start"))
        for s in starts]))["start"].alias("_start"))
    # All copies of a unit are between rows * floor(rate) and rows * ceil(rate).
    return ordered.join(best, "key").withColumn("_all", F.expr(copies("_start"))).select(
        "id", "key", "size", "rows", "source_size", "target",
        F.expr("_all div rows").cast("long").alias("base"), F.expr("_all % rows").cast("long").alias("more"))


def allocate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """id, key, size, rows, source_size, target, copies (0 to 2) and taken, for all rows of ``docs``.

    Rows equal in id, source and size are counted in ``rows``: they come as one row, or
    as two if some of them get a copy more than the others.  Null texts have size 0;
    documents of size 0 keep one copy.  A null source is a source of its own.  An empty
    table gives no rows; other columns are not read.
    """
    parts = F.array(F.struct((F.col("rows") - F.col("more")).alias("rows"), F.col("base").alias("copies")),
                    F.struct(F.col("more").alias("rows"), (F.col("base") + 1).alias("copies")))
    dealt = _decided(docs, doc_id, text, source).withColumn("_part", F.explode(parts)).filter("_part.rows > 0")
    return dealt.select("id", "key", "size", "_part.rows", "source_size", "target", "_part.copies").withColumn(
        "taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with each row repeated as often as ``allocate`` says, columns unchanged."""
    decided = checkpointed(_decided(docs, doc_id, text, source).filter("base + more > 0").select(
        F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("size").alias("_size"), "rows", "base", "more"))
    rows = docs.select(F.struct("*").alias("_row")).withColumn("_words", n_words(F.col("_row")[text]))
    same = F.col("_row")[doc_id].eqNullSafe(F.col("_id")) & (
        _source_key(F.col("_row")[source]) == F.col("_key")) & (F.col("_words") == F.col("_size"))
    dealt = rows.join(decided.filter("more = 0"), same).select("_row", F.col("base").alias("copies"))
    parted = decided.filter("more > 0")
    if not parted.isEmpty():
        dealt = dealt.union(_parted(rows.join(parted, same)))
    return dealt.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        *[F.col("_row")[c].alias(c) for c in docs.columns])


def _parted(rows: DataFrame) -> DataFrame:
    """``_row, copies``: of each unit's rows ``more`` get base + 1 copies.

    The rows are stored with a mark and numbered in salted runs of about RUN, so that a
    unit of any size is dealt by many tasks.
    """
    unit = ["_key", "_size", "_id"]
    marked = checkpointed(rows.withColumn("_mark", F.monotonically_increasing_id())).withColumn(
        "_run", F.pmod(F.xxhash64("_mark"), F.expr(f"rows div {RUN} + 1")))
    runs = marked.groupBy(*unit, "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*unit).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*[F.col(c).alias(f"{c}2") for c in (*unit, "_run")],
                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*unit, "_run").orderBy("_mark"))
    numbered = marked.select("_mark", "more", "base", *unit, "_run").withColumn("_place", place)
    on = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2")) & (
        F.col("_size") == F.col("_size2")) & (F.col("_run") == F.col("_run2"))
    copies = numbered.join(runs, on).select(
        "_mark", (F.col("base") + (F.col("_before") + F.col("_place") <= F.col("more")).cast("long")).alias("copies"))
    return marked.select("_mark", "_row").join(copies, "_mark").select("_row", "copies")
