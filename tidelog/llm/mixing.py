"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Each document gets a rate r between 0 and a cap of 2 copies. Of all rates whose words add up to the source's target, those
closest to the base rate of one copy (in relative entropy of r / cap against 1 / cap) have the form

    r = cap * sigma(logit(1 / cap) + lambda * size / mean size)

an exponential tilt of the odds with one dual variable for each source. Newton steps kept inside a bracket solve the convex
dual for each source, over the source's histogram of sizes: a bin for each size up to 64, then 64 to an octave, so that a
source has some two thousand bins at most however many documents it has. All documents of a bin share their bin's rate, and
the constraint holds exactly for these rates.

Rates are rounded to copies systematically: with the documents of a source from large to small, a document takes as many
copies as the running sum of rates passes halves. The running sum starts in each cell (source, bin, salt) at what the cells
before add up to, so a large source is rounded by many tasks. Rows of one doc_id and text that would fill a cell are dealt to several, one after the other; which of them
gets a copy more is the only thing that depends on their order. What rounding the large sizes leaves over is put into the
small ones: the smallest sizes that hold a quarter of a source's words get their rates from a second solution, whose target is
what is still missing.

Defined cases: null or empty text has size 0 and stays at its rate; null sources form one source, last in order; a target of
cap times the source takes every document cap times; repeated rows are rounded one by one, and no group of them fills a cell; a text of any length is one size, in a bin of its octave; an empty table gives no rows;
names of kept columns can't clash, since they travel in a struct, whatever letters they hold. Runs over the same rows give the same copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.common import WORD, column, documents, table, whole

STEPS = 60
CELL_ROWS = 10_000
FINE_SHARE = 0.25


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(column(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def size_bin(size: Column) -> Column:
    return F.when(size <= 64, size).otherwise(F.floor(64 * F.log2(size.cast("double")))).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes: s_null, s_name, source_size (a row per source). Adds target. Sources by code point, null last, weigh as weights say, in turn; a target stops at cap times its source, and what is over goes to the others by weight until none is above.
    The sources are numbered within ranges of names, and the ranges one after the other; the level that the open sources share comes from a sum over all for each round, and the sources that it fills are out of the next."""
    ranged = table(sizes.repartitionByRange("s_null", "s_name").withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part")  # a row per range
    ranges = ranged.groupBy("part").count().select("part", (F.sum("count").over(before) - F.col("count")).alias("earlier"))
    rank = F.col("earlier") + F.row_number().over(Window.partitionBy("part").orderBy("s_null", "s_name")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = table(ranged.join(F.broadcast(ranges), "part").select("s_null", "s_name", "source_size", weight.alias("weight"), (cap * F.col("source_size")).alias("most")), "weighed")
    every, level, filled = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share, 0.0, -1
    while True:
        full = F.col("weight") * level > F.col("most")
        used, rest, n = weighed.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count_if(full)).first()
        if n == filled or not rest:
            break
        level, filled = (every - used) / rest, n
    return weighed.select("s_null", "s_name", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("most")).cast("double").alias("target"))


def _rate(lam: Column, u: Column, cap: float) -> Column:
    """Of a document of u times the mean size."""
    return F.lit(cap) / (1.0 + F.lit(cap - 1.0) * F.exp(-F.greatest(F.least(lam * u, F.lit(500.0)), F.lit(-500.0))))


def _dual(bins: str, target: str, cap: float) -> Column:
    """The dual variable: Newton steps on the gradient (words at these rates less the target), halving the bracket where a step leaves it. bins: array of (u, words)."""

    def step(state: Column, _: Column) -> Column:
        def add(acc: Column, b: Column) -> Column:
            r = _rate(state["lam"], b["u"], cap)
            return F.struct((acc["words"] + r * b["words"]).alias("words"), (acc["slope"] + r * (1.0 - r / cap) * b["u"] * b["words"]).alias("slope"))

        at = F.aggregate(bins, F.struct(F.lit(0.0).alias("words"), F.lit(0.0).alias("slope")), add)
        return F.struct(state["lam"].alias("lam"), state["low"].alias("low"), state["high"].alias("high"), (at["words"] - F.col(target)).alias("over"), at["slope"].alias("slope"))

    def move(state: Column, i: Column) -> Column:
        at = step(state, i)
        low = F.when(at["over"] < 0, at["lam"]).otherwise(at["low"])
        high = F.when(at["over"] > 0, at["lam"]).otherwise(at["high"])
        newton = at["lam"] - at["over"] / at["slope"]
        lam = F.when(at["over"] == 0, at["lam"]).when((at["slope"] > 1e-12) & (newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        return F.struct(lam.alias("lam"), low.alias("low"), high.alias("high"))

    start = F.struct(F.lit(0.0).alias("lam"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, move)["lam"]


def _solved(histogram: DataFrame, goal: DataFrame, cap: float) -> DataFrame:
    """s_null, s_name, bin, rate. histogram: s_null, s_name, bin, n, words. goal: s_null, s_name, target."""
    per = Window.partitionBy("s_null", "s_name")
    scaled = histogram.withColumn("mean", F.sum("words").over(per) / F.sum("n").over(per)).withColumn("u", F.when(F.col("mean") > 0, F.col("words") / F.col("n") / F.col("mean")).otherwise(0.0))
    bins = scaled.groupBy("s_null", "s_name").agg(F.sort_array(F.collect_list(F.struct("bin", "u", F.col("words").cast("double").alias("words")))).alias("bins"), F.sum("words").cast("double").alias("all_words"))
    dual = bins.join(goal, ["s_null", "s_name"]).withColumn("lam", F.when(F.col("target") >= cap * F.col("all_words"), F.lit(1e6)).when(F.col("target") <= 0, F.lit(-1e6)).otherwise(_dual("bins", "target", cap)))
    return dual.select("s_null", "s_name", "lam", F.inline("bins")).select("s_null", "s_name", "bin", _rate(F.col("lam"), F.col("u"), cap).alias("rate"))


def mix(docs: DataFrame, keep: list[str] | None = None, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """record (struct of the columns in keep, all by default), size, source_size, target, rate, copies, for every row of docs."""
    name = column(source).cast("string")
    keyed = docs.select(whole(docs, keep).alias("record"), name.isNull().alias("s_null"), F.coalesce(name, F.lit("")).alias("s_name"), word_count(text).alias("size"), F.xxhash64(column(doc_id), column(text)).alias("tie"), F.monotonically_increasing_id().alias("row")).withColumn("bin", size_bin(F.col("size")))
    keyed = table(keyed, "sizes")
    narrow = keyed.select("s_null", "s_name", "bin", "size", "tie", "row")
    hot = table(narrow.groupBy("s_null", "s_name", "bin", "tie").agg(F.count("*").alias("times")).filter(F.col("times") > CELL_ROWS), "repeated")
    histogram = table(narrow.groupBy("s_null", "s_name", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "histogram")
    goal = targets(histogram.groupBy("s_null", "s_name").agg(F.sum("words").alias("source_size")), weights, share, cap)
    goal = table(goal, "targets")
    per = Window.partitionBy("s_null", "s_name")
    upward = per.orderBy("bin")
    fine = histogram.withColumn("fine", F.sum("words").over(upward) <= FINE_SHARE * F.sum("words").over(per))
    first = table(_solved(histogram, goal, cap).join(fine, ["s_null", "s_name", "bin"]), "rates")
    salts = F.ceil(F.col("n") / CELL_ROWS).cast("long")

    def copies(rows: DataFrame, rates: DataFrame) -> DataFrame:
        """Adds the copies of each row; rates: s_null, s_name, bin, n, rate."""
        cell = ["s_null", "s_name", "bin", "salt", "same", "sub"]
        split = F.pmod(F.xxhash64("row"), F.ceil(F.col("times") / CELL_ROWS).cast("long"))
        dealt = rows.join(rates, ["s_null", "s_name", "bin"]).join(hot, ["s_null", "s_name", "bin", "tie"], "left").withColumns({"salt": F.pmod("tie", salts), "same": F.when(F.col("times").isNull(), 0).otherwise(F.col("tie")), "sub": F.coalesce(split, F.lit(0))})
        cells = dealt.groupBy(*cell).agg((F.count("*") * F.first("rate")).alias("sum"))
        before = cells.select(*cell, (F.sum("sum").over(per.orderBy(F.desc("bin"), "salt", "same", "sub")) - F.col("sum")).alias("before"))
        within = F.row_number().over(Window.partitionBy(*cell).orderBy("tie"))
        placed = dealt.join(before, cell).withColumn("i", within)
        reached = lambda i: F.floor(F.round(F.col("before") + F.col("rate") * i, 6) + 0.5)
        return placed.withColumn("copies", (reached(F.col("i")) - reached(F.col("i") - 1)).cast("int"))

    coarse_sizes = copies(narrow, first.filter(~F.col("fine")))
    taken = coarse_sizes.groupBy("s_null", "s_name").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    left = goal.join(taken, ["s_null", "s_name"], "left").select("s_null", "s_name", (F.col("target") - F.coalesce("taken", F.lit(0))).alias("target"))
    second = _solved(fine.filter("fine").select("s_null", "s_name", "bin", "n", "words"), left, cap)
    rates = table(first.filter(~F.col("fine")).select("s_null", "s_name", "bin", "n", "rate").unionByName(fine.filter("fine").select("s_null", "s_name", "bin", "n").join(second, ["s_null", "s_name", "bin"])), "final-rates")
    done = copies(keyed, rates)
    return done.join(goal, ["s_null", "s_name"]).select("record", "size", "source_size", "target", "rate", "copies")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of them."""
    mixed = mix(documents(spark, sf_dir), keep=["doc_id"])
    return mixed.select("record.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
