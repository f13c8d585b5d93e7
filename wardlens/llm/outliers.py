"""Quality rules: fixed base rules and robust multivariate outliers (operator 10, native).

Each text gives a vector of transformed statistics. Per language and source, a minimum
covariance determinant estimate (location and covariance of the least spread three quarters
of the rows) is found by concentration steps, and rows whose Mahalanobis distance exceeds a
chi-squared quantile are rejected.

Every step is one grouped aggregation of a stored table of statistics: distances are counted
in fine logarithmic bins with the moments of each bin, so the three quarters with the smallest
distances follow from cumulated counts, without sorting a group and with map-side partial
sums. The subset takes in the bin that holds the quantile as a whole. Statistics are rounded
to 1/4096 and summed as decimals, so results do not depend on partitioning. Only columns of
DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.tables import materialize, without

SPACE = r"\x20\x09-\x0D"
SHARE = 0.75
MIN_GROUP = 60
BROADCAST_GROUPS = 10_000
BINS_PER_OCTAVE = 16
UNIT = 4096
# Smallest spread of each statistic that counts as ordinary, added to the diagonal. A deviation of 7.3 floors passes
# the cut by itself in a group without other spread: a quarter of all lines duplicates, a tenth of all words in
# repeated windows (base rules allow a fifth), 5 % symbols, a third capitals, words 1.8 times as long.
FLOORS = {"log_words": 0.5, "log_length": 0.08, "symbols": 0.03, "dup_lines": 0.068, "repeats": 0.043, "upper": 0.08}
DIMS = list(FLOORS)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def chi2_cdf(x: float, even_dof: int) -> float:
    """Chi-squared distribution function for an even number of degrees of freedom."""
    term, total = math.exp(-x / 2), 0.0
    for k in range(even_dof // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - total


def chi2_quantile(p_above: float, even_dof: int) -> float:
    """Value exceeded with probability ``p_above``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - chi2_cdf(middle, even_dof) > p_above else (low, middle)
    return high


def text_statistics(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """The columns ``keep`` and the base statistics of every text, in one pass without a shuffle.

    A null text has no words. Repeated five-word windows are found inside the row: hashes of
    all windows, a distinct count as test, and a sort only for texts that fail it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, text.alias("_text"), F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("_words"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(f"[^{SPACE}]"))
    names = [c for c in rows.columns if c not in ("_text", "_words")]
    rows = rows.select(
        *names,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
        lines.alias("_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hash"),
    )
    starts = F.slice("_hash", F.lit(1), F.greatest(F.size("_hash") - 4, F.lit(0)))
    rows = rows.select(
        *names, "n_words", "word_chars", "n_symbols", "n_upper",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            starts, lambda x, i: F.xxhash64(x, *(F.get("_hash", i + k) for k in range(1, 5)))
        ).alias("_grams"),
    )
    twice = F.size(F.array_distinct("_grams")) < F.size("_grams")
    pairs = F.sort_array(F.transform("_grams", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_sorted", F.when(twice, pairs)).drop("_grams")
    equal = F.filter(
        "_sorted",
        lambda x, i: F.coalesce(F.get("_sorted", i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get("_sorted", i + 1)["h"] == x["h"], F.lit(False)),
    )
    rows = rows.withColumn("_at", F.sort_array(F.transform(equal, lambda x: x["i"]))).drop("_sorted")
    fresh = F.transform("_at", lambda x, i: F.least(F.lit(5), F.coalesce(x - F.get("_at", i - 1), F.lit(5))))
    covered = F.coalesce(F.aggregate(fresh, F.lit(0), lambda total, x: total + x), F.lit(0))
    return rows.withColumn("n_repeat_words", covered.cast("long")).drop("_at")


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of them in repeated five-word windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vector() -> dict[str, Column]:
    """Transformed statistics, in units of 1/4096 as whole numbers; null for texts the base rules reject."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    values = {
        "log_words": F.log(words.cast("double")),
        "log_length": F.log(chars / words),
        "symbols": F.sqrt(F.col("n_symbols") / chars),
        "dup_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
        "upper": F.sqrt(F.col("n_upper") / chars),
    }
    return {k: F.when(~F.col("base_failed"), F.round(v * UNIT).cast("long")) for k, v in values.items()}


def _on_group(rows: DataFrame, side: DataFrame, groups: int) -> DataFrame:
    """Rows with the estimate of their group: one row of 28 numbers per group, sent to all tasks
    while the groups were counted to be few, else joined by key, where Spark splits hot groups."""
    return rows.join(F.broadcast(side) if groups <= BROADCAST_GROUPS else side, "group", "left")


def _grouped(rows: DataFrame, lang: str, source: str, size: int) -> DataFrame:
    """Rows with their group: language and source, else the rest of the language, else the rest of all."""
    good = rows.where(~F.col("base_failed"))
    pair = good.groupBy(lang, source).agg(F.count("*").alias("n"))
    pair = pair.withColumn("small", F.col("n") < size)
    rest = pair.where("small").groupBy(lang).agg(F.sum("n").alias("n_rest"))
    keys = pair.join(rest.withColumnRenamed(lang, "l2"), F.col(lang).eqNullSafe(F.col("l2")), "left")
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    name = (
        F.when(~F.col("small"), F.to_json(F.array(text(lang), text(source))))
        .when(F.col("n_rest") >= size, F.to_json(F.array(text(lang))))
        .otherwise(F.lit("[]"))
    )
    keys = keys.select(F.col(lang).alias("l2"), F.col(source).alias("s2"), name.alias("group"))
    on = F.col(lang).eqNullSafe(F.col("l2")) & F.col(source).eqNullSafe(F.col("s2"))
    return good.join(keys, on, "left").drop("l2", "s2")


def _start(rows: DataFrame) -> DataFrame:
    """Per group and statistic, median and quartile range from exact counts, as a first estimate."""
    long = rows.select("group", F.explode(F.create_map(*[x for k in DIMS for x in (F.lit(k), F.col(k))])).alias("dim", "x"))
    counts = long.groupBy("group", "dim", F.floor(F.col("x") / 16).alias("bin")).agg(F.count("*").alias("n"))
    to_here = Window.partitionBy("group", "dim").orderBy("bin")
    counts = counts.withColumn("upto", F.sum("n").over(to_here)).withColumn(
        "all", F.sum("n").over(Window.partitionBy("group", "dim"))
    )
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin") * 16 + 8)) / UNIT
    each = counts.groupBy("group", "dim").agg(at(0.5).alias("mid"), at(0.25).alias("low"), at(0.75).alias("high"))
    wide = each.groupBy("group").agg(
        *(F.max(F.when(F.col("dim") == k, F.col("mid"))).alias(f"m_{k}") for k in DIMS),
        *(F.max(F.when(F.col("dim") == k, F.col("high") - F.col("low"))).alias(f"r_{k}") for k in DIMS),
    )
    spread = [F.sqrt((F.col(f"r_{k}") / 1.349) ** 2 + FLOORS[k] ** 2).alias(f"c_{i}_{i}") for i, k in enumerate(DIMS)]
    zeros = [F.lit(0.0).alias(f"c_{i}_{j}") for i in range(len(DIMS)) for j in range(i)]
    return wide.select("group", *(f"m_{k}" for k in DIMS), *spread, *zeros)


def _distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance from the joined centre and Cholesky factor, by forward substitution."""
    for i, k in enumerate(DIMS):
        z = F.col(k) / UNIT - F.col(f"m_{k}")
        for j in range(i):
            z = z - F.col(f"c_{i}_{j}") * F.col(f"z_{j}")
        rows = rows.withColumn(f"z_{i}", z / F.col(f"c_{i}_{i}"))
    total = sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(DIMS))), F.lit(0.0))
    drop = [f"z_{i}" for i in range(len(DIMS))] + [c for c in rows.columns if c.startswith(("c_", "m_"))]
    return rows.withColumn("d2", total).drop(*drop)


def _step(rows: DataFrame, estimate: DataFrame, factor: float, groups: int) -> DataFrame:
    """One concentration step: estimate from the rows nearest to the last estimate."""
    near = _distance(_on_group(rows, estimate, groups))
    bin_of = F.floor(F.log2(F.col("d2") + 1e-6) * BINS_PER_OCTAVE)
    dims = range(len(DIMS))
    exact = lambda c: F.sum(c.cast("decimal(18,0)")).cast("decimal(38,0)")
    sums = [exact(F.col(DIMS[i])).alias(f"s_{i}") for i in dims]
    sums += [exact(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"q_{i}_{j}") for i in dims for j in range(i + 1)]
    bins = near.groupBy("group", bin_of.alias("bin")).agg(F.count("*").alias("n"), *sums)
    upto = Window.partitionBy("group").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    bins = bins.withColumn("all", F.sum("n").over(Window.partitionBy("group")))
    names = [c for c in bins.columns if c.startswith(("s_", "q_"))]
    total = lambda c: F.sum(c).cast("double")
    inner = bins.where(F.col("before") < F.ceil(F.col("all") * SHARE)).groupBy("group").agg(
        F.sum("n").alias("n"), *(total(c).alias(c) for c in names)
    )
    mean = [(F.col(f"s_{i}") / F.col("n") / UNIT).alias(f"m_{k}") for i, k in enumerate(DIMS)]
    cov = []
    for i in dims:
        for j in range(i + 1):
            c = (F.col(f"q_{i}_{j}") - F.col(f"s_{i}") * F.col(f"s_{j}") / F.col("n")) / F.col("n") / UNIT**2 * factor
            cov.append((c + (FLOORS[DIMS[i]] ** 2 if i == j else 0.0)).alias(f"v_{i}_{j}"))
    out = inner.select("group", *mean, *cov)
    for j in dims:  # Cholesky factor, column by column
        pivot = F.col(f"v_{j}_{j}")
        for k in range(j):
            pivot = pivot - F.col(f"c_{j}_{k}") * F.col(f"c_{j}_{k}")
        out = out.withColumn(f"c_{j}_{j}", F.sqrt(F.greatest(pivot, F.lit(FLOORS[DIMS[j]] ** 2 / 100))))
        for i in range(j + 1, len(DIMS)):
            rest = F.col(f"v_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"c_{i}_{k}") * F.col(f"c_{j}_{k}")
            out = out.withColumn(f"c_{i}_{j}", rest / F.col(f"c_{j}_{j}"))
    return out.drop(*(c for c in out.columns if c.startswith("v_")))


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    p_above: float = 1e-9,
    steps: int = 6,
    min_group: int = MIN_GROUP,
) -> DataFrame:
    """``doc_id, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance``.

    One row per row of ``docs``, repeated rows included. A null text has no words and fails
    the base rules. Null languages and sources form groups of their own. Groups with fewer than
    ``min_group`` rows pass their rows on to the rest of the language, then to the rest of all;
    where even that is too small, the base rules alone decide. ``distance`` is null for rows
    that the base rules reject. Other columns are not read.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keep = [F.col(c).alias(a) for c, a in ((id_col, "doc_id"), (lang_col, "lang"), (source_col, "source"))]
    stats = text_statistics(docs, text_col, [*keep, text_hash.alias("text_hash")])
    stats = stats.withColumn("base_failed", base_failed())
    stats = materialize(stats.withColumns(vector()).drop("n_upper", "n_lines"), "quality-statistics")
    rows = materialize(_grouped(stats, "lang", "source", min_group), "quality-groups")
    dims = len(DIMS)
    factor = SHARE / chi2_cdf(chi2_quantile(1 - SHARE, dims), dims + 2)
    estimate = materialize(_start(rows), "quality-start")
    narrow = rows.select("group", *DIMS)
    groups = estimate.count()
    for _ in range(steps):
        estimate = materialize(_step(narrow, estimate, factor, groups), "quality-step")
    sizes = rows.groupBy("group").agg(F.count("*").alias("group_rows"))
    judged = _distance(_on_group(rows, estimate.join(sizes, "group"), groups))
    far = F.coalesce((F.col("d2") > chi2_quantile(p_above, dims)) & (F.col("group_rows") >= min_group), F.lit(False))
    columns = ["doc_id", "text_hash", *COUNTS, "base_failed"]
    judged = judged.select(*columns, (~far).alias("kept"), F.col("d2").alias("distance"))
    failed = stats.where("base_failed").select(
        *columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")
    )
    return judged.unionByName(failed)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they are."""
    verdict = judge(docs, **options).where("NOT kept").select("doc_id", "text_hash")
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    mine = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return without(docs, verdict, docs[id_col], mine)
