"""Quality rules: plain limits, then robust multivariate outliers per language and source. DataFrame functions only.

The outliers come from a minimum-covariance-determinant estimate. Each group has four deterministic starts around its
medians: absolute deviations alone, covariances of signs and of bounded scores, and that of the half nearest to the medians.
Each is concentrated: keep the three quarters of a group's rows nearest to its centre, estimate centre and covariance from
them, measure all rows anew. The one of least determinant goes on until its determinant falls no more. Covariances are
regularised by a fixed floor, as parts may be constant in a group. Each step is a quantile and a set of sums per group and
start, which are summed up before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import SPACES, written

WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Of the statistic vector: floor of the standard deviation of each part, so that a part that is constant in a group doesn't make the covariance singular.
FLOORS = {"x0": 0.25, "x1": 0.25, "x2": 0.25, "x3": 0.25}
PARTS = list(FLOORS)
KEPT_SHARE, LEAST_ROWS = 0.75, 50
#: Of quantiles: ranks are right to one in so many.
ACCURACY = 10_000
#: Starts of each group, steps of each before the best is chosen, and steps of that one at most.
STARTS, FIRST_STEPS, LAST_STEPS = 4, 2, 6
#: What the covariance of the nearest three quarters of a normal cloud in four dimensions lacks: 0.75 / P(chi2 of 6 <= 5.385).
CONSISTENCY = 0.75 / 0.505
#: Squared distance beyond which a row goes; far out, as clean documents must stay: chi2 of 4 exceeds it once in 10^11.
LIMIT = 60.0
#: In so many slices the rows of each group are joined with what is estimated for it.
SLICES = 256


def held(expression: Column, name: str) -> Column:
    """A computed array as a row's own value: a generator keeps Catalyst from computing it anew wherever it is used."""
    return F.explode(F.array(expression)).alias(name)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of the base rules of every text; a null text has no words."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("t"))
    bare = F.translate("t", SPACES, "")
    lines = F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = base.select(
        "doc_id", "lang", "source",
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        held(lines, "lines"), "t",
    )
    counted = counted.select("doc_id", "lang", "source", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "t")
    hashed = counted.select("*", held(F.transform(F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), ""), lambda w: F.xxhash64(w)), "h")).drop("t")
    n = F.size("h")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get("h", i + k) for k in range(WINDOW))))
    windows = hashed.select("*", n.cast("long").alias("n_words"), held(F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")), "w")).drop("h")
    some = F.size(F.array_distinct("w")) < F.size("w")
    ordered = windows.select("*", held(F.when(some, F.sort_array(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))), "s")).drop("w")
    x = lambda j: F.get("s", j)["x"]
    again = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda j: F.coalesce((j > 0) & (x(j) == x(j - 1)), F.lit(False)) | F.coalesce(x(j) == x(j + 1), F.lit(False)))
    places = F.sort_array(F.transform(again, lambda j: F.get("s", j)["i"]))
    covered = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")))["n"]
    return ordered.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(F.col("s").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """The transformed statistic vector. Shares are drawn towards usual values as in texts of 40 further words, since in short texts they vary by chance."""
    more = F.col("n_words") + 40
    return stats.withColumns({
        "x0": (F.col("word_chars") + 200) / more,
        "x1": F.asinh(20 * F.col("n_symbols") / more),
        "x2": F.asinh(20 * F.col("n_dup_lines") / more),
        "x3": F.asinh(10 * F.col("n_repeat_words") / more),
    })


def factors(cov: dict[tuple[int, int], Column]) -> dict[str, Column]:
    """The Cholesky factor of a covariance, as expressions."""
    low: dict[tuple[int, int], Column] = {}
    for i in range(len(PARTS)):
        for j in range(i + 1):
            rest = cov[i, j]
            for k in range(j):
                rest = rest - low[i, k] * low[j, k]
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / low[j, j]
    return {f"l{i}{j}": c for (i, j), c in low.items()}


def by_group(rows: DataFrame, groups: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group.

    ``groups`` is a written table, so that Spark knows its size: a small one is sent to the rows, which then needn't be
    shuffled. Beyond Spark's limit every group is repeated once a slice, so that a group of any share of the rows meets
    its estimate in as many tasks.
    """
    keys = ["g_lang", "g_source", *({"start"} & set(groups.columns)), "slice"]
    return rows.join(groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))), keys, how)


def measured(rows: DataFrame, model: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with d2, the squared Mahalanobis distance from the centre of their group."""
    joined = by_group(rows, model, how)
    z: list[Column] = []
    for i, part in enumerate(PARTS):
        rest = F.col(part) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * z[k]
        z.append(rest / F.col(f"l{i}{i}"))
    return joined.select(*(rows[c] for c in rows.columns), sum((c * c for c in z), F.lit(0.0)).alias("d2"))


def model_of(sums: DataFrame, keys: list[str], cov: dict[tuple[int, int], Column]) -> DataFrame:
    """The keys, centre m0.., Cholesky factor l00.. and logarithm of the determinant of each group, written."""
    n = range(len(PARTS))
    made = sums.select(*keys, *(f"m{i}" for i in n), *(c.alias(k) for k, c in factors(cov).items()))
    return written(made.withColumn("det", sum((2 * F.log(F.col(f"l{i}{i}")) for i in n), F.lit(0.0))), "model")


def concentrated(rows: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """The model that the rows nearest to ``model`` give."""
    n = range(len(PARTS))
    far = measured(rows, model)
    edge = far.groupBy(*keys).agg(F.percentile_approx("d2", KEPT_SHARE, ACCURACY).alias("edge"))
    near = by_group(far, written(edge, "edge")).where("d2 <= edge")
    sums = near.groupBy(*keys).agg(*(F.avg(p).alias(f"m{i}") for i, p in enumerate(PARTS)), *(F.covar_pop(PARTS[i], PARTS[j]).alias(f"c{i}{j}") for i in n for j in range(i + 1)))
    return model_of(sums, keys, {(i, j): F.col(f"c{i}{j}") * CONSISTENCY + (FLOORS[PARTS[i]] ** 2 if i == j else 0.0) for i in n for j in range(i + 1)})


def starts(rows: DataFrame) -> DataFrame:
    """(g_lang, g_source, start, ...): the models from which each group's estimates start; all are centred on the medians."""
    keys = ["g_lang", "g_source"]
    n = range(len(PARTS))
    centre = rows.groupBy(*keys).agg(*(F.percentile_approx(p, 0.5, ACCURACY).alias(f"m{i}") for i, p in enumerate(PARTS)))
    spread = by_group(rows, written(centre, "centre")).groupBy(*keys).agg(*(F.first(f"m{i}").alias(f"m{i}") for i in n), *(F.percentile_approx(F.abs(F.col(p) - F.col(f"m{i}")), 0.5, ACCURACY).alias(f"s{i}") for i, p in enumerate(PARTS)))
    scale = written(spread.select(*keys, *(f"m{i}" for i in n), *(F.sqrt(F.pow(1.4826 * F.col(f"s{i}"), 2) + FLOORS[PARTS[i]] ** 2).alias(f"s{i}") for i in n)), "scale")
    placed = by_group(rows, scale).withColumns({f"z{i}": (F.col(p) - F.col(f"m{i}")) / F.col(f"s{i}") for i, p in enumerate(PARTS)})
    placed = placed.withColumn("size", F.sqrt(sum((F.col(f"z{i}") ** 2 for i in n), F.lit(0.0))))
    half = by_group(placed, written(placed.groupBy(*keys).agg(F.percentile_approx("size", 0.5, ACCURACY).alias("half")), "half"))
    bounded = {1: lambda i: F.col(f"z{i}") / F.greatest("size", F.lit(1e-9)), 2: lambda i: F.tanh(f"z{i}"), 3: lambda i: F.when(F.col("size") <= F.col("half"), F.col(f"z{i}"))}
    sums = half.groupBy(*keys).agg(*(F.first(f"{x}{i}").alias(f"{x}{i}") for x in "ms" for i in n), *(F.covar_pop(f(i), f(j)).alias(f"c{k}{i}{j}") for k, f in bounded.items() for i in n for j in range(i + 1)))
    shape = lambda k, i, j: (F.lit(1.0 if i == j else 0.0) if k == 0 else F.col(f"c{k}{i}{j}") + (0.05 if i == j else 0.0)) * F.col(f"s{i}") * F.col(f"s{j}")
    each = sums.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    cov = {}
    for i in n:
        for j in range(i + 1):
            chosen = shape(0, i, j)
            for k in bounded:
                chosen = F.when(F.col("start") == k, shape(k, i, j)).otherwise(chosen)
            cov[i, j] = chosen
    return model_of(each, [*keys, "start"], cov)


def robust_models(rows: DataFrame) -> DataFrame:
    """(g_lang, g_source, m0.., l00.., det): centre and Cholesky factor of each group, of the least determinant found."""
    keys = ["g_lang", "g_source"]
    each = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1))))
    model = starts(rows)
    for _ in range(FIRST_STEPS):
        model = concentrated(each, model, [*keys, "start"])
    best = model.groupBy(*keys).agg(F.min(F.struct("det", "start", *(c for c in model.columns if c[0] in "ml"))).alias("best"))
    model = written(best.select(*keys, "best.*").drop("start"), "model")
    for _ in range(LAST_STEPS):
        after = concentrated(rows, model, keys)
        falls = after.join(model.select(*keys, F.col("det").alias("before")), keys).where("det < before - 1e-9").limit(1).count()
        model = written(model.withColumn("old", F.lit(1)).unionByName(after.withColumn("old", F.lit(0))).groupBy(*keys).agg(F.min(F.struct("det", "old", *(c for c in model.columns if c[0] in "ml"))).alias("best")).select(*keys, "best.*").drop("old"), "model")
        if not falls:
            break
    return model


def judge(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Per row of ``docs``: the base counts, base_failed, d2 and kept.

    Null texts have no words and fail. Null languages or sources are a group like others. Groups of fewer than 50 rows are
    measured by all rows of such groups together; where no estimate can be made, d2 is null and the base rules alone count.
    Repeated rows and doc_ids are judged row by row; an empty table gives an empty result.
    """
    stats = written(statistics(docs), "statistics")
    base = vectors(stats).withColumns({"slice": F.pmod(F.xxhash64("doc_id", *PARTS, F.spark_partition_id(), F.monotonically_increasing_id()), F.lit(SLICES)).cast("int"), "g_lang": coded("lang"), "g_source": coded("source")})
    counts = written(base.groupBy("g_lang", "g_source").agg(F.count("*").alias("n")), "counts")
    named = lambda c: F.when(F.col("n") >= LEAST_ROWS, F.col(c)).otherwise("*").alias(c)
    rows = written(by_group(base, counts).select("doc_id", *COUNTS, *PARTS, "slice", named("g_lang"), named("g_source")), "vectors")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    model = robust_models(rows.where(~failed))
    out = measured(rows, model, "left")
    return out.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.coalesce("d2", F.lit(0.0)) <= limit)).alias("kept"), "d2")


def coded(name: str) -> Column:
    """A language or source as the key of a group, which is never null."""
    return F.when(F.col(name).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(name)))
