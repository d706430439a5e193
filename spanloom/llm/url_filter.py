"""URL filters: rules first, and gradient-boosted trees on lexical features where no rule fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import first_by_hash, ready, removed, written

#: Distinct labelled urls that the trees are trained on: the first of each verdict by a hash, in the verdicts' shares of
#: TRAIN_ROWS, but LEAST_ROWS of each at least (all, if fewer).
TRAIN_ROWS, LEAST_ROWS = 20_000, 1000
TREES, DEPTH, SEED = 20, 4, 5
#: Weight, in rows, of the overall share in a suffix's share of blocked urls.
PRIOR = 20.0
#: Suffixes with the most urls, whose statistics are broadcast; those of all others are joined by a shuffle.
SUFFIXES = 10_000
FEATURES = ("length", "host_length", "depth", "labels", "digits", "entropy", "params", "dashes", "longest", "has_fragment", "suffix_share", "suffix_count", "site_share")


def host(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host, up to ? # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; columns host and path are there. A rule is a host and then a path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit("/" + p if "/" in text else ""))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _suffix(n: int) -> Column:
    labels = F.split("host", r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def _entropy(x: Column) -> Column:
    """Bits a character, from how often each of its characters occurs."""
    n = F.greatest(F.length(x), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(x, ""))
    share = lambda c: (F.length(x) - F.length(F.replace(x, c, F.lit("")))) / n
    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def _lexical(urls: DataFrame) -> DataFrame:
    u = F.col("u")
    return (
        urls.withColumn("length", F.length(u).cast("double"))
        .withColumn("host_length", F.length("host").cast("double"))
        .withColumn("depth", F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"))
        .withColumn("labels", F.size(F.split("host", r"\.")).cast("double"))
        .withColumn("digits", F.length(F.regexp_replace(u, "[^0-9]", "")) / F.greatest(F.length(u), F.lit(1)))
        .withColumn("entropy", _entropy(u))
        .withColumn("params", F.size(F.filter(F.split(F.regexp_extract(u, r"(?s)\?([^#]*)", 1), "&"), lambda x: x != "")).cast("double"))
        .withColumn("dashes", F.length(F.regexp_replace(u, "[^-_]", "")).cast("double"))
        .withColumn("longest", F.coalesce(F.array_max(F.transform(F.split("path", "[/._-]"), F.length)), F.lit(0)).cast("double"))
        .withColumn("has_fragment", F.contains(u, F.lit("#")).cast("double"))
        .withColumn("suffix", _suffix(1))
        .withColumn("site", _suffix(2))
    )


def _found(df: DataFrame, name: str, stats: DataFrame) -> DataFrame:
    """df with name_n and name_y of each row's suffix, null where no labelled url has it.

    The commonest suffixes are a bounded table and broadcast, so no hot one meets in one task; rows that found theirs
    there are dealt by their own hash, the others by their suffix.
    """
    values = [f"{name}_n", f"{name}_y"]
    hot = stats.orderBy(F.desc("rows"), name).limit(SUFFIXES).select(name, F.struct(*values).alias("__hot"))
    told = df.join(F.broadcast(hot), name, "left")
    if stats.count() <= SUFFIXES:
        return told.select(*df.columns, *[F.col("__hot")[v].alias(v) for v in values])
    rest = stats.where(F.col(values[0]) > 0).select(F.lit(True).alias("__cold"), F.col(name).alias("__key"), F.struct(*values).alias("__rest"))
    key = F.when(F.col("__hot").isNull(), F.col(name)).otherwise(F.xxhash64(*df.columns).cast("string"))
    met = told.withColumns({"__cold": F.col("__hot").isNull(), "__key": key}).join(rest, ["__cold", "__key"], "left")
    return met.select(*df.columns, *[F.coalesce("__hot", "__rest")[v].alias(v) for v in values])


def _sample(labelled: DataFrame) -> DataFrame:
    """Distinct labelled urls to train on, with how many rows each has as `copies`; both verdicts are there if both are."""
    once = written(labelled.groupBy("u", "host", "path", "y").agg(F.count(F.lit(1)).alias("copies")))
    count = {r["y"]: r["count"] for r in once.groupBy("y").count().collect()}
    total = sum(count.values())
    parts = [first_by_hash(once.where(F.col("y") == y), "u", max(LEAST_ROWS, TRAIN_ROWS * n // total), n) for y, n in sorted(count.items())]
    chosen = written(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
    removed(once)
    return chosen


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", withhold: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): each url's verdict, allow or block.

    `rules` are (host and path prefix, verdict) for a host and its subdomains; the longest that fits decides. The urls
    that rules decide are the labelled ones: the trees are trained on them and decide the rest, block from a score of 0.5
    on. If rules leave only one verdict, or none, the rest gets it, or allow. Suffix statistics (blocked share and count
    by last label and by last two) cover all labelled urls, and each url's own rows are left out of what it sees in
    training. A null url or one without :// has an empty host and path. Rows that repeat stay, and teach once; other
    columns are ignored. Rows for which `withhold`, a condition on pages, holds teach nothing: their score is what the
    trees say without them, whatever their rule.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready(pages.sparkSession)
    u = F.coalesce(F.col(url_col), F.lit(""))
    aside = F.lit(False) if withhold is None else F.coalesce(withhold, F.lit(False))
    urls = pages.select(F.col(id_col).alias("page_id"), u.alias("u"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), aside.alias("aside"))
    rule, verdict = _rule(rules)
    urls = urls.withColumn("rule", rule).withColumn("told", verdict)
    labelled = urls.where(F.col("rule").isNotNull() & ~F.col("aside")).withColumn("y", (F.col("told") == "block").cast("double"))
    total = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).first()
    out = ["page_id", "host", "path", "rule"]
    if not total.n or total.y in (0, total.n):
        rest = "block" if total.n and total.y else "allow"
        return urls.select(*out, F.coalesce("told", F.lit(rest)).alias("verdict"), F.lit(float(rest == "block")).alias("score"))
    share = total.y / total.n

    marked = urls.select("host", F.when(F.col("rule").isNotNull() & ~F.col("aside"), (F.col("told") == "block").cast("double")).alias("y"))

    def stats(name: str, n: int) -> DataFrame:
        """All suffixes: their urls, and how many of them are labelled and blocked."""
        return written(marked.groupBy(_suffix(n).alias(name)).agg(F.count(F.lit(1)).alias("rows"), F.count("y").alias(f"{name}_n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias(f"{name}_y")))

    known = {"suffix": stats("suffix", 1), "site": stats("site", 2)}

    def with_stats(df: DataFrame, own: Column) -> DataFrame:
        y = F.col("y") if "y" in df.columns else F.lit(0.0)
        for name in known:
            df = _found(df, name, known[name])
            count, bad = F.coalesce(f"{name}_n", F.lit(0)) - own, F.coalesce(f"{name}_y", F.lit(0.0)) - own * y
            df = df.withColumn(f"{name}_share", (bad + PRIOR * share) / (count + PRIOR)).withColumn(f"{name}_count", F.log1p(F.greatest(count, F.lit(0)).cast("double")))
        return df

    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    taught = written(with_stats(_lexical(_sample(labelled)), F.col("copies")).select(*FEATURES, "y"))
    trees = GBTClassifier(labelCol="y", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=SEED, cacheNodeIds=False).fit(vector.transform(taught))
    scored = trees.transform(vector.transform(with_stats(_lexical(urls), F.lit(0))))
    score = vector_to_array("probability")[1]
    return scored.select(*out, F.coalesce("told", F.when(score >= 0.5, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), score.alias("score"))
