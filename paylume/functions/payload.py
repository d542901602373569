"""Statistics of binary payloads as DataFrame operations. Undefined statistics are NaN here, as too short a payload has
none; a null payload has no bytes and counts as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN = float("nan")


def latin(payload: Column | str) -> Column:
    """One character per byte, so that string functions address bytes."""
    return F.decode(payload, "ISO-8859-1")


def byte_array(payload: Column | str) -> Column:
    return F.when(F.coalesce(F.octet_length(payload), F.lit(0)) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split(latin(payload), ""), F.ascii))


def exploded(df: DataFrame, *keep: str) -> DataFrame:
    """``id``, kept columns, ``pos`` from 1 and ``x`` for each byte."""
    return df.select("id", *keep, F.posexplode(F.split(latin("payload"), "")).alias("p", "c")).where("c <> ''").select("id", *keep, (F.col("p") + 1).alias("pos"), F.ascii("c").alias("x"))


def byte_counts(df: DataFrame, *keep: str) -> DataFrame:
    """Counts of the bytes that occur, combined map-side: at most 256 rows a payload are shuffled."""
    return exploded(df, *keep).groupBy("id", *keep, "x").agg(F.count("*").alias("c"))


def count_profile(df: DataFrame, *keep: str) -> DataFrame:
    """Entropy (bits a byte), uniformity chi-square over 256 bins (NaN under 16 bytes) and index of coincidence."""
    counts = byte_counts(df, *keep).groupBy("id", *keep).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("clogc"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    found = counts.select(
        "id",
        *keep,
        "n",
        F.greatest(F.lit(0.0), F.log2("n") - F.col("clogc") / F.col("n")).alias("entropy"),
        F.when(F.col("n") < 16, F.lit(NAN)).otherwise(256.0 * F.col("cc") / F.col("n") - F.col("n")).alias("chi2"),
        F.when(F.col("n") < 2, F.lit(0.0)).otherwise((F.col("cc") - F.col("n")) / (F.col("n") * (F.col("n") - 1.0))).alias("ic"),
    )
    empty = df.where(F.coalesce(F.octet_length("payload"), F.lit(0)) == 0).select("id", *keep, F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("entropy"), F.lit(NAN).alias("chi2"), F.lit(0.0).alias("ic"))
    return found.unionByName(empty)


def histogram(df: DataFrame) -> DataFrame:
    """256 columns of relative frequencies, all 0.0 for an empty payload."""
    sizes = df.select("id", F.coalesce(F.octet_length("payload"), F.lit(0)).alias("n"))
    wide = byte_counts(df).groupBy("id").pivot("x", list(range(256))).agg(F.first("c"))
    return sizes.join(wide, "id", "left").select("id", *((F.coalesce(F.col(f"`{i}`"), F.lit(0)) / F.greatest("n", F.lit(1))).alias(f"byte_hist_{i:03d}") for i in range(256)))


def grams(df: DataFrame, n: int) -> DataFrame:
    """Overlapping grams of n bytes, packed into one number, counted by payload."""
    # dealt by id once, so that both levels of grouping use the same partitioning
    starts = F.sequence(F.lit(1), F.octet_length("payload") - (n - 1))
    pos = df.where(F.octet_length("payload") >= n).repartition("id").select("id", F.explode(F.transform(starts, lambda i: F.conv(F.hex(F.col("payload").substr(i, F.lit(n))), 16, 10).cast("long"))).alias("g"))
    return pos.groupBy("id", "g").agg(F.count("*").alias("c"))


def gram_profile(df: DataFrame, n: int) -> DataFrame:
    """Entropy, distinct grams k, largest relative frequency, chi-square over the grams that occur (0 for one), and the
    unseen share of all possible grams (called collision rate). NaN for payloads shorter than a gram."""
    found = grams(df, n).groupBy("id").agg(F.sum("c").alias("m"), F.count("*").alias("k"), F.max("c").alias("top"), F.sum(F.col("c") * F.log2("c")).alias("clogc"), F.sum(F.col("c") * F.col("c")).alias("cc"))
    stats = found.select(
        "id",
        F.greatest(F.lit(0.0), F.log2("m") - F.col("clogc") / F.col("m")).alias("entropy"),
        F.col("k").cast("double").alias("distinct"),
        (F.col("top") / F.col("m")).alias("max_freq"),
        F.when(F.col("k") == 1, F.lit(0.0)).otherwise(F.col("cc") * F.col("k") / F.col("m") - F.col("m")).alias("chi2"),
        (1 - F.col("k") / float(256**n)).alias("collision_rate"),
    )
    names = stats.columns[1:]
    return df.select("id").join(stats, "id", "left").select("id", *(F.coalesce(c, F.lit(NAN)).alias(c) for c in names))


def lag_sums(df: DataFrame, lags: list[int], *keep: str) -> DataFrame:
    """Per payload: n, sum, sum of squares and, per lag k, the raw product sum and the sums of head and tail. Products
    are of integers; centring is done by algebra, not inside a lambda."""
    bytes_ = df.select("id", *keep, byte_array("payload").alias("a"))
    # a generated array of one keeps the byte array from being worked out once per element
    once = bytes_.select("id", *keep, F.explode(F.array("a")).alias("a"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    columns = [F.size("a").cast("long").alias("n"), total(F.col("a")).alias("s"), total(F.transform("a", lambda x: (x * x).cast("long"))).alias("ss")]
    n = F.size("a")
    once = once.select("id", *keep, "a", *columns)
    out = [F.col("n"), F.col("s"), F.col("ss")]
    for k in lags:
        few = F.least(F.lit(k), n)
        head, tail = F.slice("a", F.lit(1), F.greatest(n - k, F.lit(0))), F.slice("a", F.lit(k + 1), F.greatest(n - k, F.lit(0)))
        # the sums of head and tail are the whole sum less the last or first k bytes
        out += [total(F.zip_with(head, tail, lambda x, y: (x * y).cast("long"))).alias(f"p_{k}"), (F.col("s") - total(F.slice("a", n - few + 1, few))).alias(f"h_{k}"), (F.col("s") - total(F.slice("a", F.lit(1), few))).alias(f"t_{k}")]
    return once.select("id", *keep, *out)


def autocorrelation(df: DataFrame, lags: list[int]) -> DataFrame:
    """``acf_k``: mean product of centred pairs over the population variance, clipped to [-1, 1]; NaN from lag n on; a
    constant payload has 1.0 at lags below its length."""
    n, one = F.col("n"), F.greatest(F.col("n"), F.lit(1))
    m = F.col("s") / one
    var = F.col("ss") / one - m * m
    out = []
    for k in lags:
        centred = (F.col(f"p_{k}") - m * (F.col(f"h_{k}") + F.col(f"t_{k}")) + (n - k) * m * m) / F.greatest(n - k, F.lit(1))
        out.append(F.when(n <= k, F.lit(NAN)).when(var < 1e-12, F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), centred / var))).alias(f"acf_{k}"))
    return lag_sums(df, lags).select("id", *out)


def plain_autocorrelation(df: DataFrame, lag: int, *keep: str) -> DataFrame:
    """The product sum of centred pairs over the sum of squares, not scaled by their numbers; 0 for short or constant
    payloads."""
    n, m = F.col("n"), F.col("s") / F.greatest(F.col("n"), F.lit(1))
    centred = F.col(f"p_{lag}") - m * (F.col(f"h_{lag}") + F.col(f"t_{lag}")) + (n - lag) * m * m
    squares = F.col("ss") - n * m * m
    return lag_sums(df, [lag], *keep).select("id", *keep, F.when((n <= lag + 1) | (squares < 1e-9), F.lit(0.0)).otherwise(centred / squares).alias("acf"))


def runs(df: DataFrame) -> DataFrame:
    """Runs of bytes above the median and their z score; NaN where the test has no variance, both under two bytes."""
    once = df.select("id", F.explode(F.array(byte_array("payload"))).alias("a")).select("id", "a", F.array_sort("a").alias("o"), F.size("a").alias("n"))
    half = F.floor(F.col("n") / 2).cast("int")
    median = F.when(F.col("n") % 2 == 1, F.get("o", half).cast("double")).otherwise((F.get("o", half) + F.get("o", half - 1)) / 2.0)
    flagged = once.select("id", "n", F.explode(F.array(median)).alias("m"), "a").select("id", "n", F.transform("a", lambda x: (x > F.col("m")).cast("int")).alias("f"))
    flagged = flagged.select("id", "n", F.explode(F.array("f")).alias("f"))
    sums = flagged.select("id", "n", F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + x).alias("n1"), F.aggregate(F.zip_with(F.slice("f", F.lit(1), F.greatest(F.col("n") - 1, F.lit(0))), F.slice("f", 2, 2147483646), lambda x, y: F.abs(x - y)), F.lit(1).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0))).alias("runs"))
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    cross = 2 * n1 * (n - n1)
    mean, var = cross / n + 1, cross * (cross - n) / (n * n * (n - 1))
    z = F.when((n1 == 0) | (n1 == n) | (var <= 0), F.lit(NAN)).otherwise((F.col("runs") - mean) / F.sqrt(var))
    return sums.select("id", F.when(n < 2, F.lit(NAN)).otherwise(F.col("runs").cast("double")).alias("runs_count"), F.when(n < 2, F.lit(NAN)).otherwise(z).alias("runs_z"))


def block_repetition(df: DataFrame, size: int = 16, *keep: str) -> DataFrame:
    """Share of full blocks whose content stands more than once; 0 with fewer than two blocks."""
    many = F.floor(F.coalesce(F.octet_length("payload"), F.lit(0)) / size).cast("int")
    blocks = df.where(many >= 2).select("id", F.explode(F.sequence(F.lit(0), many - 1)).alias("i"), "payload").select("id", F.col("payload").substr(F.col("i") * size + 1, F.lit(size)).alias("block"))
    counted = blocks.groupBy("id", "block").agg(F.count("*").alias("c")).groupBy("id").agg((F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("rate"))
    return df.select("id", *keep).join(counted, "id", "left").select("id", *keep, F.coalesce("rate", F.lit(0.0)).alias("rate"))


def fixed_sequence(payload: Column | str, size: int) -> Column:
    """The first ``size`` bytes as an array, padded with zeros."""
    first = F.col(payload) if isinstance(payload, str) else payload
    bytes_ = byte_array(first.substr(1, size))  # only these are split to bytes
    return F.slice(F.concat(bytes_, F.array_repeat(F.lit(0), size)), 1, size)


def fixed_grid(payload: Column | str, size: int) -> Column:
    """Rows of ``size`` bytes over 255, cut or padded to ``size`` rows."""
    if size <= 0:
        raise ValueError("size must be positive")
    flat = F.transform(fixed_sequence(payload, size * size), lambda x: x / 255.0)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.slice(flat, i * size + 1, size))
