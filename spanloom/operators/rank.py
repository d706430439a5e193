"""Top-k, picks, orders and mixes. Every choice has a total order; ranks stay inside their group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.interval import with_same

#: Dense numbers in one lot.
LOT = 1 << 16


def _rank(keys: list[str], *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], lots: list[Column], into: str = "pos", size: str | None = None) -> DataFrame:
    """df with each row's number, from 1, in its keys' order, and the rows of its keys as `size` if asked for.

    `lots` never fall along that order: rows are counted by lot, the counts summed over the keys' lots, and rows ranked
    inside theirs, so that a key of any size is ranked in many tasks.
    """
    names = [f"__lot{i}" for i in range(len(lots))]
    told = df.withColumns(dict(zip(names, lots, strict=True)))
    told = told.withColumn("__own", F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order)))
    per = told.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    base = per.withColumns({"__base": F.coalesce(F.sum("__rows").over(before), F.lit(0)), "__all": F.sum("__rows").over(Window.partitionBy(*keys))}).drop("__rows")
    met = with_same(told, base, [*keys, *names]).withColumn(into, (F.col("__base") + F.col("__own")).cast("long"))
    if size is not None:
        met = met.withColumn(size, F.col("__all"))
    return met.drop(*names, "__own", "__base", "__all")


def lots_of(df: DataFrame, order: str, lots: int = 64) -> Column:
    """Which of `lots` ranges of about as many rows each a numeric column's value lies in; its quantiles are found first."""
    shares = [i / lots for i in range(1, lots)]
    at = df.agg(F.approx_percentile(order, shares, F.lit(16 * lots)).alias("at")).first().at
    return F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(at))]), lambda x: x < F.col(order))) if at else F.lit(0)


def top_k(df: DataFrame, keys: list[str], value: str, tie: str, k: int | None = None) -> DataFrame:
    """The k rows of highest value by keys, or all, the smaller `tie` first; with their rank."""
    ranked = df.withColumn("rank", _rank(keys, F.desc(value), tie))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def top_k_other(df: DataFrame, keys: list[str], label: str, value: str, k: int, other: str = "Other contexts") -> DataFrame:
    """The top k labels, and one row for all others; a null label is a row of its own, `Window unknown`."""
    named = df.withColumn("known", F.col(label).isNotNull())
    ranked = named.withColumn("rank", _rank([*keys, "known"], F.desc(value), label))
    shown = F.when(~F.col("known"), "Window unknown").when(F.col("rank") <= k, F.col(label)).otherwise(other)
    return ranked.groupBy(*keys, shown.alias("label")).agg(F.sum(value).alias(value))


def latest_per_bucket(df: DataFrame, keys: list[str], at: str, bucket_us: int, tie: str) -> DataFrame:
    """The last row in each bucket of time."""
    b = df.withColumn("bucket", F.floor(F.col(at) / bucket_us))
    return b.groupBy(*keys, "bucket").agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(at, tie)).alias("r")).select(*keys, "bucket", "r.*")


def best_per_bucket(df: DataFrame, keys: list[str], at: str, bucket_us: int, priority: list[str], tie: str) -> DataFrame:
    """The row of highest priority in each bucket, the smallest `tie` among equals."""
    b = df.withColumn("bucket", F.floor(F.col(at) / bucket_us))
    return b.withColumn("r", _rank([*keys, "bucket"], *[F.desc(p) for p in priority], tie)).where("r = 1").drop("r")


def even_spread(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """k rows at even distances: places i*(n-1)/(k-1) rounded half to even, the middle one for k = 1; all if n <= k."""
    told = numbered(df, keys, [order], [lots_of(df, order)], "pos", "n").withColumn("pos", F.col("pos") - 1)
    if k == 1:
        return told.where((F.col("n") <= 1) | (F.col("pos") == F.floor(F.col("n") / 2))).drop("n")
    picks = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("n") - 1) / (k - 1), 0).cast("long"))
    return told.where((F.col("n") <= k) | F.array_contains(picks, F.col("pos"))).drop("n")


def bisect_level(pos: Column, n: Column) -> Column:
    """How many halvings of [0, n) reach a place: breadth first, midpoints of a level come left to right."""
    begin = F.struct(F.lit(0).cast("long").alias("lo"), (n - 1).alias("hi"), F.lit(0).alias("level"), F.lit(False).alias("done"))

    def step(a, _):
        mid = F.floor((a["lo"] + a["hi"]) / 2)
        hit = a["done"] | (mid == pos)
        return F.struct(
            F.when(~hit & (pos > mid), mid + 1).otherwise(a["lo"]).alias("lo"),
            F.when(~hit & (pos < mid), mid - 1).otherwise(a["hi"]).alias("hi"),
            F.when(hit, a["level"]).otherwise(a["level"] + 1).alias("level"),
            hit.alias("done"),
        )

    halvings = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int") + 1)
    return F.aggregate(halvings, begin, step, lambda a: a["level"]).cast("long")


def bisect_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with `ord`: an order in which any first rows cover the whole range."""
    told = numbered(df, keys, [order], [lots_of(df, order)], "pos", "n").withColumn("pos", F.col("pos") - 1)
    told = told.withColumn("level", bisect_level(F.col("pos"), F.col("n")))
    return numbered(told, keys, ["level", "pos"], [F.col("level"), F.floor(F.col("pos") / LOT)], "ord").drop("level", "n")


def context_priority(df: DataFrame, keys: list[str], context: list[str], order: str) -> DataFrame:
    """df with `ord`: the middle row of each context first, these in bisect order, then the rest by `order`."""
    told = numbered(df, [*keys, *context], [order], [lots_of(df, order)], "r", "m")
    told = told.withColumn("first", F.col("r") == F.floor(F.col("m") / 2) + 1).drop("r", "m")
    lead = bisect_order(told.where("first"), keys, order).drop("pos", "first")
    rest = told.where("NOT first").drop("first")
    rest = numbered(rest, keys, [order], [lots_of(rest, order)], "ord")
    leads = lead.groupBy(*keys).agg(F.count(F.lit(1)).alias("__leads"))
    return lead.unionByName(with_same(rest, leads, keys).withColumn("ord", F.col("ord") + F.col("__leads")).drop("__leads"))


def round_robin(df: DataFrame, keys: list[str], group: str, order: str, limit: int) -> DataFrame:
    """One row of each group in turn, groups by name, up to `limit` by keys."""
    # A row's place is not before its turn, so no later turn is looked at; tasks drop those before they shuffle.
    told = df.withColumn("turn", _rank([*keys, group], order)).where(F.col("turn") <= limit)
    return told.withColumn("ord", _rank(keys, "turn", group)).where(F.col("ord") <= limit)


def stride_sample(df: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """Rows at places int(i * n / k) for i below k; all if n <= k."""
    told = numbered(df, keys, [order], [lots_of(df, order)], "pos", "n").withColumn("pos", F.col("pos") - 1)
    # pos is a pick if some i has floor(i*n/k) = pos: the least i with i*n >= pos*k does.
    i = F.ceil(F.col("pos") * k / F.col("n"))
    return told.where((F.col("n") <= k) | ((F.floor(i * F.col("n") / k) == F.col("pos")) & (i < k))).drop("n")


def ratio_mix(current: DataFrame, history: DataFrame, keys: list[str], order: str, ratio: int, limit: int) -> DataFrame:
    """`ratio` current rows, then one of history, again and again; one that is left alone goes on."""
    c = current.withColumns({"r": _rank(keys, order), "lane": F.lit("current")}).where(F.col("r") <= limit)
    h = history.withColumns({"r": _rank(keys, order), "lane": F.lit("history")}).where(F.col("r") <= limit)
    c = c.withColumn("slot", F.col("r") + F.floor((F.col("r") - 1) / ratio))
    h = h.withColumn("slot", F.col("r") * (ratio + 1))
    both = c.unionByName(h)
    return both.withColumn("ord", _rank(keys, "slot", "lane", "r")).where(F.col("ord") <= limit).drop("slot", "r")


def alternate(a: DataFrame, b: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One of a, one of b, and so on."""
    both = a.withColumn("lane", F.lit(0).cast("long")).unionByName(b.withColumn("lane", F.lit(1).cast("long")))
    told = numbered(both, [*keys, "lane"], [order], [lots_of(both, order)], "r")
    sizes = both.groupBy(*keys).agg(F.count_if(F.col("lane") == 0).alias("__a"), F.count_if(F.col("lane") == 1).alias("__b"))
    # Before the r-th of a come r - 1 of b, or all; before the r-th of b come r of a, or all.
    place = F.col("r") + F.when(F.col("lane") == 0, F.least(F.col("r") - 1, F.col("__b"))).otherwise(F.least(F.col("r"), F.col("__a")))
    return with_same(told, sizes, keys).withColumn("ord", place).drop("r", "__a", "__b")


def quality_diverse(df: DataFrame, keys: list[str], group: list[str], variant: str, order: str, limit: int) -> DataFrame:
    """Groups in turn; in a group the first row of each variant comes before a variant's second."""
    # Neither a row's turn nor its place is before what it is within its variant.
    told = df.withColumn("seen", _rank([*keys, *group, variant], order)).where(F.col("seen") <= limit)
    told = told.withColumn("turn", _rank([*keys, *group], "seen", order)).where(F.col("turn") <= limit)
    return told.withColumn("ord", _rank(keys, "turn", *group)).where(F.col("ord") <= limit).drop("seen")


def hour_coverage(df: DataFrame, keys: list[str], hour: str, value: str, tie: str) -> DataFrame:
    """The longest of each hour first, hours in bisect order, in turns."""
    lot = lots_of(df, value)
    told = numbered(df, [*keys, hour], [F.desc(value), tie], [-lot], "turn")
    hours = bisect_order(df.select(*keys, hour).distinct(), keys, hour).withColumnRenamed("ord", "hour_ord").drop("pos")
    return numbered(told.join(hours, [*keys, hour]), keys, ["turn", "hour_ord"], [F.floor(F.col("turn") / LOT)], "ord").drop("hour_ord")


def seeded_order(df: DataFrame, keys: list[str], id_col: str, seed: int) -> DataFrame:
    """A reproducible shuffle: by a digest of seed and id."""
    told = df.withColumn("__md5", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))))
    return numbered(told, keys, ["__md5", id_col], [F.substr("__md5", F.lit(1), F.lit(3))], "ord").drop("__md5")


def page(df: DataFrame, keys: list[str], order: str, offset: int, rows: int = 20) -> DataFrame:
    """One page of each key's rows with the total."""
    told = df.withColumn("pos", _rank(keys, order)).where(F.col("pos") <= offset + rows).where(F.col("pos") > offset)
    return with_same(told, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")), keys)


def temporal_split(df: DataFrame, day: str) -> DataFrame:
    """df with `split`: the last day tests, the one before validates, the others train."""
    days = df.select(day).distinct().orderBy(F.desc(day)).limit(2)
    # One row joins every row: the first and the last day.
    last = F.broadcast(days.agg(F.max(day).alias("d1"), F.min(day).alias("d2")))
    told = df.join(last)
    return told.withColumn("split", F.when(F.col(day) == F.col("d1"), "test").when(F.col(day) == F.col("d2"), "validation").otherwise("train")).drop("d1", "d2")


def split_leaks(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys present in more than one split."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("splits")).where("splits > 1")
