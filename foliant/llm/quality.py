"""Quality rules: fixed limits on counts of words and lines, then robust multivariate outliers per language and source.

All of it is DataFrame expressions. Each text is read once, into a narrow written table of counts. A group's location and scatter are its minimum-covariance-determinant estimate: of the sets of H_SHARE of its rows that concentration steps lead to from several starts, the one whose covariance has the least determinant: FIRST_STEPS steps from each, then on from the best one until its determinant falls no more. A step takes the rows whose squared Mahalanobis distance is at most the group's quantile at H_SHARE (percentile_approx, with a rank error below 1/ACCURACY) and computes their mean and covariance by sums that combine before the shuffle, so a group with a third of all rows is no hot spot. The covariance is scaled to be consistent for normal data, FLOOR is added to its diagonal (many texts have no symbol and no repeat at all, so a half of them has no spread), and rows beyond CUT are outliers. The floors are small enough for each statistic to pass CUT on its own: in a group without repeats, over 44 of a hundred repeated lines do, or as many repeated words, which is below the fixed limit.

Groups: (language, source), for fewer than LEAST_GROUP rows the language, for fewer the whole table; rows are given no verdict where that has fewer, too. Only rows that pass the fixed limits count and are judged by distance.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import documents, small, written

#: Vector of a text: ln(1 + words); ln of the mean word length; ln(1 + symbols, repeated lines, repeated words in a hundred characters, lines, words).
VECTOR = ("v_words", "v_length", "v_symbols", "v_lines", "v_repeats")
#: Variances that are added to the covariance's diagonal.
FLOOR = (0.05, 0.01, 0.1, 0.4, 0.4)
H_SHARE, ACCURACY, LEAST_GROUP = 0.75, 10_000, 50
#: Starts from a part of the rows each, besides those from medians and from all rows, and what part of them that is.
PART_STARTS, PART = 2, 8
#: Steps from every start; after them the log determinant's least fall that calls for another step from the best start, and a bound on those for sets that percentile_approx's error keeps moving.
FIRST_STEPS, LEAST_FALL, MOST_STEPS = 2, 1e-4, 50
#: Tail of the chi-squared distribution beyond which a row is an outlier.
TAIL = 1e-6

_WORDS = r"split(coalesce(text, ''), '[\\x20\\x09-\\x0D]+')"


def _chi2_cdf(x: float, k: float) -> float:
    """By the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, k: float) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


CUT = chi2_quantile(1 - TAIL, len(VECTOR))
_SCALE = H_SHARE / _chi2_cdf(chi2_quantile(H_SHARE, len(VECTOR)), len(VECTOR) + 2)


def text_counts(docs: DataFrame) -> DataFrame:
    """docs without text, with n_words, word_chars, n_symbols, n_lines (that have a word), n_dup_lines and n_repeat_words.

    Words are runs of characters other than \\x20 and \\x09-\\x0D; a null text has none. n_repeat_words: the words that lie in a three-word window found twice or more. Each window becomes a long of its 64-bit hash's upper bits and its place in the lower ones; sorted, windows alike are neighbours, and neighbours' words are compared before they count."""
    step = docs.withColumns({"_w": F.expr(f"array_remove({_WORDS}, '')"), "_lines": F.expr(r"filter(split(coalesce(text, ''), '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')")})
    step = step.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.expr("regexp_count(coalesce(text, ''), '[#*$%&|<>]')").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_bits": F.length(F.bin(F.size("_w").cast("long"))),
        "_h": F.expr("transform(_w, w -> xxhash64(w))"),
    })
    step = step.withColumn("_s", F.expr("if(n_words < 3, array(), sort_array(transform(slice(_h, 1, greatest(size(_h) - 2, 1)), (h, i) -> shiftleft(xxhash64(h, _h[i + 1], _h[i + 2]), _bits) | i)))"))
    same = "(shiftright(x, _bits) = shiftright(get(_s, i {0} 1), _bits) AND get(_w, cast(x & _m AS int)) = get(_w, cast(get(_s, i {0} 1) & _m AS int)) AND get(_w, cast(x & _m AS int) + 1) = get(_w, cast(get(_s, i {0} 1) & _m AS int) + 1) AND get(_w, cast(x & _m AS int) + 2) = get(_w, cast(get(_s, i {0} 1) & _m AS int) + 2))"
    step = step.withColumn("_m", F.expr("shiftleft(1L, _bits) - 1"))
    step = step.withColumn("_at", F.expr(f"sort_array(transform(filter(_s, (x, i) -> {same.format('-')} OR {same.format('+')}), x -> x & _m))"))
    step = step.withColumn("n_repeat_words", F.expr("aggregate(transform(_at, (x, i) -> least(3L, coalesce(get(_at, i + 1), x + 3) - x)), 0L, (a, x) -> a + x)"))
    return step.drop("text", "_w", "_lines", "_bits", "_h", "_s", "_m", "_at")


_PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i + 1)]


def _factor(params: DataFrame) -> DataFrame:
    """params (m0.., c00..) with Cholesky's factor l00.. of the covariance and its log determinant: column by column, so that no expression repeats another's work."""
    for i, j in _PAIRS:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return params.withColumn("logdet", sum((F.log(f"l{i}{i}") for i in range(1, len(VECTOR))), F.log("l00")) * 2)


def _with_distance(rows: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """rows with d2, their squared distance by their group's params."""
    factors = params.select(*keys, *(f"m{i}" for i in range(len(VECTOR))), *(f"l{i}{j}" for i, j in _PAIRS))
    names = rows.columns
    joined = rows.join(small(factors), keys)
    for i, v in enumerate(VECTOR):
        rest = F.col(v) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        joined = joined.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return joined.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, len(VECTOR))), F.col("z0") * F.col("z0"))).select(*names, "d2")


def _moments(rows: DataFrame, keys: list[str], scale: float) -> DataFrame:
    """Mean and covariance, times scale and with the floors, of each group's rows."""
    sums = rows.groupBy(*keys).agg(*(F.avg(v).alias(f"m{i}") for i, v in enumerate(VECTOR)), *(F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c{i}{j}") for i, j in _PAIRS))
    return _factor(sums.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * scale + (FLOOR[i] if i == j else 0.0) for i, j in _PAIRS}))


def mcd_params(rows: DataFrame) -> DataFrame:
    """g and the estimate of each group. rows: a written table with g and the vector.

    Starts: the distances by each group's median and median absolute deviation, by its plain mean and covariance, and by those of PART_STARTS parts of its rows, drawn by a hash of the vector."""
    p = range(len(VECTOR))
    median = rows.groupBy("g").agg(*(F.percentile_approx(v, 0.5, ACCURACY).alias(f"m{i}") for i, v in enumerate(VECTOR)))
    off = rows.join(small(written(median, "median")), "g")
    spread = off.groupBy("g").agg(*(F.first(f"m{i}").alias(f"m{i}") for i in p), *((F.pow(F.percentile_approx(F.abs(F.col(VECTOR[i]) - F.col(f"m{i}")), 0.5, ACCURACY) * 1.4826, F.lit(2.0)) + FLOOR[i]).alias(f"c{i}{i}") for i in p))
    spread = _factor(spread.withColumns({f"c{i}{j}": F.lit(0.0) for i, j in _PAIRS if i != j}))
    # s: 0 by medians, 1 all rows, from 2 on a part of the rows
    drawn = rows.withColumn("s", F.explode(F.array_compact(F.array(F.lit(1), *(F.when(F.pmod(F.xxhash64(*VECTOR, F.lit(s)), F.lit(PART)) == 0, s) for s in range(2, 2 + PART_STARTS))))))
    keys = ["g", "s"]
    starts = spread.withColumn("s", F.lit(0)).unionByName(_moments(drawn, keys, 1.0))
    both = rows.withColumn("s", F.explode(F.array(*(F.lit(s) for s in range(2 + PART_STARTS)))))

    def step(table: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
        far = _with_distance(table.join(small(params.select(*keys)), keys, "left_semi"), params, keys)
        limit = written(far.groupBy(*keys).agg(F.percentile_approx("d2", H_SHARE, ACCURACY).alias("limit")), "limit")
        return written(_moments(far.join(small(limit), keys).where("d2 <= limit"), keys, _SCALE), "mcd")

    # a few steps from every start, then on from the best one of each group
    params = written(starts, "mcd")
    for _ in range(FIRST_STEPS):
        params = step(both, params, keys)
    best = Window.partitionBy("g").orderBy("logdet", "s")
    falling = written(params.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "s"), "mcd")
    done = falling.limit(0)
    for _ in range(MOST_STEPS):
        after = step(rows, falling, ["g"])
        more = written(after.join(small(falling.select("g", F.col("logdet").alias("_before"))), "g").where(F.col("logdet") < F.col("_before") - LEAST_FALL).drop("_before"), "mcd")
        done = done.unionByName(falling.join(small(more.select("g")), "g", "left_anti"))
        falling = more
        if falling.isEmpty():
            break
    return written(done.unionByName(falling), "mcd")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and distance (squared; null where a row isn't judged by it) for each row of docs (doc_id, text, lang, source).

    base_failed: fewer than 50 words, or over half of them in repeated three-word windows. A null language or source is a value like any other. Repeated rows count each, empty and null texts fail the base, an empty table gives no rows, other columns are ignored."""
    counts = text_counts(docs.select("doc_id", "text", "lang", "source"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    share = lambda x, of: F.log1p(100.0 * F.col(x) / F.greatest(F.col(of), F.lit(1)))
    table = written(
        counts.withColumns({
            "base_failed": failed,
            "v_words": F.log1p(F.col("n_words").cast("double")),
            "v_length": F.log((F.col("word_chars") + 1.0) / (F.col("n_words") + 1.0)),
            "v_symbols": share("n_symbols", "word_chars"),
            "v_lines": share("n_dup_lines", "n_lines"),
            "v_repeats": share("n_repeat_words", "n_words"),
        }),
        "counts",
    )
    levels = [F.to_json(F.struct(F.lit(2).alias("level"), "lang", "source")), F.to_json(F.struct(F.lit(1).alias("level"), "lang")), F.lit('{"level":0}')]
    sizes = table.where("NOT base_failed").select(F.explode(F.array(*levels)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    sizes = written(sizes.where(F.col("n") >= LEAST_GROUP), "groups")
    judged = table.where("NOT base_failed").withColumn("g", F.explode(F.array(*levels))).select("g", *VECTOR)
    params = mcd_params(written(judged.join(small(sizes.select("g")), "g", "left_semi"), "vectors"))
    # the finest group of each row that has an estimate
    known = params.select("g")
    own = table.select("lang", "source").distinct().withColumn("_g", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), x.alias("g")) for i, x in enumerate(levels)))))
    own = own.join(known, F.col("_g.g") == known["g"], "left_semi").groupBy("lang", "source").agg(F.min("_g").alias("_g"))
    own = own.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("_g.g").alias("g"))
    factors = params.select("g", *(f"m{i}" for i in range(len(VECTOR))), *(f"l{i}{j}" for i, j in _PAIRS))
    final = table.join(small(written(own.join(factors, "g"), "own")), table["lang"].eqNullSafe(F.col("_lang")) & table["source"].eqNullSafe(F.col("_source")), "left")
    for i, v in enumerate(VECTOR):
        rest = F.col(v) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        final = final.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    distance = F.when(~F.col("base_failed"), sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, len(VECTOR))), F.col("z0") * F.col("z0")))
    return final.withColumn("distance", distance).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUT)).alias("kept"), "distance")


def op9_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir))


QUERIES = {"op9_mcd_quality": op9_mcd_quality}
SQL: dict[str, str] = {}
