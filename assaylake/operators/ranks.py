"""Exact ranks from one sort by ranges, and what follows from them; no window holds a whole table or a hot value.

Distinct values are counted first, so a value that fills a third of the table is one row of the sort. Ranges of values
are sorted where they lie, each task counts what it holds, and offsets are sums over tasks.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from assaylake.functions.scratch import written


def value_ranks(df: DataFrame, value: str, *keys: str, times: str | None = None) -> DataFrame:
    """(keys, value, n, below): each distinct value of a key, how often it occurs, and how many smaller ones there are.

    Null values are left out; null keys are a key like others. A row counts `times` times where that is given. The
    result is read from a written table.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(times) if times else F.count("*")).alias("n"))
    told = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(k) for k in keys]), {"ignoreNullFields": "false"})
    order = [F.asc_nulls_first(k) for k in keys] + [F.asc(value)]
    spread = counted.withColumn("__key", told).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(parts):
        part, last, total = TaskContext.get().partitionId(), None, 0
        for pdf in parts:
            if not len(pdf):
                continue
            new = pdf["__key"].ne(pdf["__key"].shift(fill_value=last))
            group = new.cumsum()
            before = pdf.groupby(group)["n"].cumsum() - pdf["n"]
            before = before + (group == 0) * total  # goes on with the key that the last rows had
            last = pdf["__key"].iloc[-1]
            total = int(before.iloc[-1] + pdf["n"].iloc[-1])
            yield pdf.assign(__before=before.astype("int64"), __part=part)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema)
    local = written(spread.mapInPandas(run, f"{fields}, __before long, __part int"), "value-ranks")
    totals = local.groupBy("__key", "__part").agg(F.sum("n").alias("__n"))
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over the tasks of a key
    base = totals.select("__key", "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    return local.join(base, ["__key", "__part"]).select(*keys, value, "n", (F.col("__before") + F.col("__base")).alias("below"))


def ranked(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """df with `rank_low` and `rank_high`, the ranks from 1 of the first and the last of the rows that tie, and `rank_of`,
    the number of ranked rows of the key; null where the value is."""
    ranks = value_ranks(df, value, *keys)
    sizes = ranks.groupBy(*keys).agg(F.sum("n").alias("rank_of")) if keys else ranks.agg(F.sum("n").alias("rank_of"))
    renamed = ranks.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(value).alias("__value"), (F.col("below") + 1).alias("rank_low"), (F.col("below") + F.col("n")).alias("rank_high"))
    same = F.col(value) == F.col("__value")
    out = df.join(renamed, _both(same, keys), "left").drop("__value", *[f"__{k}" for k in keys])
    sizes = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], "rank_of")
    return (out.join(sizes, _both(F.lit(True), keys), "left") if keys else out.crossJoin(F.broadcast(sizes))).drop(*[f"__{k}" for k in keys])


def _both(start: Column, keys: tuple[str, ...]) -> Column:
    for k in keys:
        start = start & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return start


def percentiles(ranks: DataFrame, value: str, shares: list[float], *keys: str) -> DataFrame:
    """(keys, n, q): from value_ranks(), the exact percentiles of each key, between neighbours in proportion; one aggregate."""
    sizes = ranks.groupBy(*keys).agg(F.sum("n").alias("__of")) if keys else ranks.agg(F.sum("n").alias("__of"))
    x = ranks.join(sizes, list(keys)) if keys else ranks.crossJoin(F.broadcast(sizes))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col(value)))

    aggs = []
    for i, share in enumerate(shares):
        place = F.lit(share) * (F.col("__of") - 1)
        aggs += [at(F.floor(place)).alias(f"__lo{i}"), at(F.ceil(place)).alias(f"__hi{i}")]
    got = x.groupBy(*keys).agg(F.max("__of").alias("n"), *aggs)
    part = lambda i, share: (F.lit(share) * (F.col("n") - 1)) - F.floor(F.lit(share) * (F.col("n") - 1))
    q = F.array(*[F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * part(i, share) for i, share in enumerate(shares)])
    return got.select(*keys, "n", q.alias("q"))


def moments(ranks: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, n, mean, sd): mean and population deviation from value_ranks(), centred before squaring."""
    total = [F.sum("n").alias("n"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean")]
    mean = ranks.groupBy(*keys).agg(*total) if keys else ranks.agg(*total)
    away = F.col(value) - F.col("mean")
    x = ranks.withColumnRenamed("n", "__n")
    x = x.join(mean, list(keys)) if keys else x.crossJoin(F.broadcast(mean))
    sd = F.sqrt(F.sum(away * away * F.col("__n")) / F.sum("__n")).alias("sd")
    return x.groupBy(*keys).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), sd)


#: The inverse of the normal distribution after Wichura, Algorithm AS 241 (1988), from the highest power
#: down; the centre by q, and the tails by sqrt(-ln p), down to p of 1e-11.
CENTRE_UP = [2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0]
CENTRE_DOWN = [5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0]
TAIL_UP = [7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0]
TAIL_DOWN = [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0]


def inverse_normal_sql(p: str, d: str = "D") -> str:
    """The value of which a share `p` (a column between 0 and 1) of a normal distribution is smaller. `d` marks a double."""

    def polynomial(by_power: list[float], x: str) -> str:
        out = f"{by_power[0]!r}{d}"
        for c in by_power[1:]:
            out = f"({out} * {x} + {c!r}{d})"
        return out

    q, r = f"({p} - 0.5{d})", f"(0.180625{d} - ({p} - 0.5{d}) * ({p} - 0.5{d}))"
    t = f"(sqrt(-ln(least({p}, 1.0{d} - {p}))) - 1.6{d})"
    centre = f"{polynomial(CENTRE_UP, r)} * {q} / {polynomial(CENTRE_DOWN, r)}"
    tail = f"{polynomial(TAIL_UP, t)} / {polynomial(TAIL_DOWN, t)}"
    return f"CASE WHEN abs({q}) <= 0.425{d} THEN {centre} WHEN {q} < 0 THEN -({tail}) ELSE {tail} END"


EDGE = 1e-7


def rank_share(low: Column, high: Column, of: Column) -> Column:
    """Where a row stands between the smallest, 0, and the largest, 1, by the mean of the ranks that tie; one row alone: 1/2."""
    return F.when(of > 1, (low + high - 2) / (2 * (of - 1))).otherwise(0.5)


def rank_transform(table: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, z): each column as normal quantiles of its ranks, shares kept off 0 and 1 by 1e-7, over the root of the
    number of columns, so that views of many columns weigh no more than others. Undefined values become 0, the middle.
    """
    long = table.select(id_col, F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])))
    x = ranked(long.where("v IS NOT NULL"), "v", "place").withColumn("p", rank_share(F.col("rank_low"), F.col("rank_high"), F.col("rank_of")))
    x = x.withColumn("p", F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), "p"))).withColumn("z", F.expr(inverse_normal_sql("p")) / len(columns) ** 0.5)
    placed = table.select(id_col).distinct().join(x.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("place", "z"))).alias("m")), id_col, "left")
    return placed.select(id_col, F.array(*[F.coalesce(F.col("m")[F.lit(i)], F.lit(0.0)) for i in range(len(columns))]).alias("z"))
