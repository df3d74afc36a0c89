r"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Simple rules first: a text fails with fewer than 20 words, or with more than 30 % of its words in
repeated runs of eight. For every language and source the others' statistics, transformed, get a
minimum-covariance-determinant estimate: the mean and covariance of the three quarters of the rows
whose covariance has the least determinant. Concentration steps find them: distances under the
present estimate, the nearest three quarters, a new estimate from those; from two starts (medians,
and means), of which the one with the smaller determinant counts. A last step re-estimates from all
rows within the 97.5 % quantile, and texts beyond the 99.99 % quantile of the squared Mahalanobis
distance are rejected.

A step is one combinable aggregation: rows are counted and their moments summed by distance, in
fine logarithmic bins, and running totals over a group's bins (at most some thousands, whatever the
group's size) find the bin that completes the three quarters. So no group is sorted or gathered.
Statistics are whole thousandths, so sums do not depend on the order of rows. The smallest spread a
statistic can have is a floor added to the covariance's diagonal, without which shares that are
zero in most texts would have none. Groups of fewer than 50 rows share an estimate per language, and
where these are few too, one for all.

Cases: null and empty texts have no words and fail; a null language or source is a group of its own;
equal rows get equal verdicts; ids are not used. Texts of any length are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.stage import evaluate, let
from lexweave.session import cut_lineage

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
STEPS, SHARE, LEAST_ROWS = 6, 0.75, 50
SPACE = "[ \\t\\n\\x0B\\f\\r]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UNIT = 1000
#: Least spreads: log word length, root shares of symbols, repeated lines and words, log words.
FLOORS = (0.05, 0.04, 0.08, 0.15, 0.25)
P = len(FLOORS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def chi2_cdf(x: float, k: int) -> float:
    """Of the chi-square distribution with an odd number of degrees of freedom."""
    term, total = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 0.0
    for i in range(1, k, 2):
        total += term
        term *= x / (i + 2)
    return math.erf(math.sqrt(x / 2)) - total


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < q else (low, middle)
    return low


def consistency(share: float) -> float:
    """The factor that a normal sample's covariance loses when only its nearest share is kept."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)




def _repeated_words(hashes: Column) -> Column:
    """Words covered by windows that occur twice: equal neighbours in hash order, back in place."""

    def marked(order: Column) -> Column:
        def own(x: Column, j: Column) -> Column:
            same = (F.get(order, j - 1)["h"] == x["h"]) | (F.get(order, j + 1)["h"] == x["h"])
            return F.when(same, x["i"])

        return F.sort_array(F.filter(F.transform(order, own), lambda i: i.isNotNull()))

    def covered(starts: Column) -> Column:
        steps = F.transform(
            starts,
            lambda i, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - i, F.lit(WINDOW))),
        )
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    paired = F.transform(
        hashes, lambda h, i: F.named_struct(F.lit("h"), h, F.lit("i"), i)
    )
    return let(F.sort_array(paired), lambda order: let(marked(order), covered))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, the four base statistics and base_failed."""
    value = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(value, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    lines = F.filter(F.split(value, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    bare, spaces = F.length(value), F.length(F.translate(value, SPACES, ""))
    cut = evaluate(
        docs,
        words=words,
        word_chars=spaces.cast("long"),
        n_symbols=(bare - F.length(F.translate(value, SYMBOLS, ""))).cast("long"),
        n_dup_lines=let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    )
    n = F.size("words")
    runs = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), n - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice("words", i, WINDOW)),
        )
    )
    hashed = evaluate(cut, n_words=n.cast("long"), runs=runs).drop("words")
    again = F.size("runs") > F.size(F.array_distinct("runs"))
    counted = evaluate(
        hashed,
        n_repeat_words=F.when(again, _repeated_words(F.col("runs"))).otherwise(0).cast("long"),
    ).drop("runs")
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    return counted.withColumn("base_failed", failed)


def _vector() -> list[Column]:
    n = F.greatest("n_words", F.lit(1)).cast("double")
    values = [
        F.log(F.greatest("word_chars", F.lit(1)) / n),
        F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
        F.log(n),
    ]
    return [F.round(v * UNIT).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def _moments() -> list[Column]:
    """Count, sums and sums of products, exact."""
    exact = "decimal(20,0)"
    firsts = [F.sum(F.col(f"x{i}").cast(exact)).alias(f"s{i}") for i in range(P)]
    seconds = [
        F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast(exact)).alias(f"s{i}_{j}") for i, j in PAIRS
    ]
    return [F.count("*").alias("n"), *firsts, *seconds]


def _estimate(moments: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Means m*, and the inverse a*_* of the covariance's Cholesky factor, and log determinant."""
    out = moments.where("n > 0")
    out = out.withColumns(
        {f"m{i}": F.col(f"s{i}").cast("double") / F.col("n") / UNIT for i in range(P)}
    )
    out = out.withColumns(
        {
            f"c{i}_{j}": F.lit(factor)
            * (
                F.col(f"s{i}_{j}").cast("double") / F.col("n") / UNIT**2
                - F.col(f"m{i}") * F.col(f"m{j}")
            )
            + (FLOORS[i] ** 2 if i == j else 0.0)
            for i, j in PAIRS
        }
    )
    for i, j in PAIRS:
        inner = F.col(f"c{i}_{j}")
        for k in range(j):
            inner = inner - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        value = (
            F.sqrt(F.greatest(inner, F.lit(FLOORS[i] ** 2 / 4))) if i == j else inner / F.col(f"l{j}_{j}")
        )
        out = out.withColumn(f"l{i}_{j}", value)
    for i in range(P):
        for j in range(i, -1, -1):
            if i == j:
                value = 1 / F.col(f"l{i}_{i}")
            else:
                value = F.lit(0.0)
                for k in range(j, i):
                    value = value - F.col(f"l{i}_{k}") * F.col(f"a{k}_{j}")
                value = value / F.col(f"l{i}_{i}")
            out = out.withColumn(f"a{i}_{j}", value)
    spread = sum((F.log(F.col(f"l{i}_{i}")) for i in range(1, P)), F.log("l0_0"))
    return out.select(
        *keys,
        *[f"m{i}" for i in range(P)],
        *[f"a{i}_{j}" for i, j in PAIRS],
        spread.alias("spread"),
    )


def _distance() -> Column:
    """The squared Mahalanobis distance under the joined estimate."""
    total = F.lit(0.0)
    for i in range(P):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col(f"a{i}_{j}") * (F.col(f"x{j}") / UNIT - F.col(f"m{j}"))
        total = total + z * z
    return total


def _nearest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The moments of each group's nearest three quarters."""
    bin_ = F.floor(64 * F.log2(1 + F.col("d") * 16)).alias("bin")
    binned = rows.groupBy(*keys, bin_).agg(*_moments())
    sums = [c for c in binned.columns if c not in (*keys, "bin")]
    upto = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    running = binned.select(
        *keys,
        "bin",
        F.sum("n").over(whole).alias("rows"),
        (F.sum("n").over(upto) - F.col("n")).alias("earlier"),
        *[F.sum(c).over(upto).alias(c) for c in sums],
    )
    # The first bin whose running count reaches the share.
    need = F.floor(F.col("rows") * SHARE)
    return running.where((F.col("n") >= need) & (F.col("earlier") < need) & (need > 0)).select(
        *keys, *sums
    )


def _group() -> Column:
    return F.to_json(F.struct(F.col("lang").alias("l"), F.col("source").alias("s")))


def estimates(rows: DataFrame) -> DataFrame:
    """The final estimate per group; ``rows`` has grp and the x columns."""
    keys = ["grp", "start"]
    middle = rows.groupBy("grp").agg(
        *[F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in range(P)]
    )
    # First estimates: around the medians with the floors' spread, and the moments of all rows.
    first = middle.select(
        "grp",
        F.lit(0).alias("start"),
        *[(F.col(f"m{i}") / UNIT).alias(f"m{i}") for i in range(P)],
        *[F.lit(1 / FLOORS[i] if i == j else 0.0).alias(f"a{i}_{j}") for i, j in PAIRS],
        F.lit(0.0).alias("spread"),
    )
    everything = rows.groupBy("grp").agg(*_moments()).withColumn("start", F.lit(1))
    now = cut_lineage(first.unionByName(_estimate(everything, keys, 1.0)))
    for _ in range(STEPS):
        near = rows.join(now, "grp").withColumn("d", _distance())
        now = cut_lineage(_estimate(_nearest(near, keys), keys, consistency(SHARE)))
    best = Window.partitionBy("grp").orderBy("spread", "start")
    chosen = now.withColumn("rank", F.row_number().over(best)).where("rank = 1").drop("rank")
    inside = rows.join(chosen, "grp").withColumn("d", _distance())
    inside = inside.where(F.col("d") <= chi2_quantile(0.975, P)).groupBy("grp").agg(*_moments())
    return cut_lineage(_estimate(inside, ["grp"], consistency(0.975)))


def with_verdicts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) with the statistics, base_failed, kept and distance."""
    stats = text_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text")
    stats = cut_lineage(stats.withColumn("own", _group()).select("*", *_vector()))
    good = stats.where("not base_failed")
    sizes = good.groupBy("own", "lang").count()
    sizes = sizes.withColumn("few", F.col("count") < LEAST_ROWS)
    by_lang = sizes.where("few").groupBy("lang").agg(F.sum("count").alias("pooled"))
    pooled = F.when(
        F.col("pooled") >= LEAST_ROWS, F.to_json(F.struct(F.col("lang").alias("l")))
    ).otherwise("{}")
    names = (
        sizes.join(by_lang.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left")
        .select("own", F.when(F.col("few"), pooled).otherwise(F.col("own")).alias("grp"))
    )
    x = [f"x{i}" for i in range(P)]
    rows = cut_lineage(good.join(names, "own").select("grp", *x))
    final = names.join(estimates(rows), "grp")
    judged = stats.join(final, "own", "left")
    inside = F.coalesce(_distance() <= chi2_quantile(0.9999, P), F.lit(True))
    return judged.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & inside).alias("kept"),
        F.round(_distance(), 3).alias("distance"),
    )
