"""Document statistics and robust multivariate outliers, on DataFrame functions alone.

Each group of documents (language and source) gets a minimum-covariance-determinant estimate of
the location and scatter of its transformed statistics: from several starts, concentration steps
re-estimate both from the ``share`` of documents nearest by Mahalanobis distance; the start whose
determinant is least goes on until the determinant stands still. The scatter of the nearest is
made consistent with that of normal data, and one reweighting step takes all documents within the
0.975 quantile. Documents far from their group's estimate are rejected. A step is one pass: sums
of values and products per (group, distance bin) are combined before the shuffle; a window over
the bins, not the documents, finds the bin that completes the share. A group that holds a third of
all rows is summed by all tasks like any other.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.scratch import release, written

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

#: Transformed statistics: name, expression, least standard deviation of clean text, and whether only values above
#: the location count against a document. Added counts shrink the ratios of short texts toward those of ordinary prose.
FEATURES: tuple[tuple[str, str, float, bool], ...] = (
    ("f_word_length", "ln((word_chars + 100D) / (n_words + 20D))", 0.08, False),
    ("f_symbols", "ln(1D + 1000D * n_symbols / (word_chars + 200D))", 0.6, True),
    ("f_dup_lines", "ln(1D + 100D * n_dup_lines / (n_lines + 20D))", 0.8, True),
    ("f_repeats", "ln(1D + 100D * n_repeat_words / (n_words + 100D))", 0.6, True),
    ("f_capitals", "ln((100D * n_capitals + 600D) / (word_chars + 400D))", 0.25, False),
    ("f_marks", "ln((100D * n_marks + 1000D) / (word_chars + 400D))", 0.25, False),
    ("f_line_words", "ln((n_words + 40D) / (n_lines + 2D))", 0.5, False),
)
#: The share of normal data that is rejected, by the chi-square quantile of as many degrees of freedom as statistics.
TAIL = 1e-4
#: Distance bins per unit of ln(1 + d^2); distances are compared by bin, which makes a step exact and repeatable.
BINS = 64
#: Groups whose estimates are broadcast (about 400 bytes each).
BROADCAST_GROUPS = 20_000
#: Steps of every start before the best goes on, most steps after that, and the change of the
#: logarithm of the determinant at which they end before.
START_STEPS, MOST_STEPS, STILL = 2, 8, 1e-3


def chi2_share(d2: float, d: int) -> float:
    """The share of a chi-square distribution with ``d`` degrees of freedom below ``d2``."""
    if d2 <= 0:
        return 0.0
    a, x = d / 2, d2 / 2
    term = math.exp(a * math.log(x) - x - math.lgamma(a + 1))
    total, k = 0.0, 0
    while term > total * 1e-17:
        total += term
        k += 1
        term *= x / (a + k)
    return min(total, 1.0)


@lru_cache
def chi2_quantile(share: float, d: int) -> float:
    low, high = 0.0, 10.0 * d + 200
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_share(middle, d) < share else (low, middle)
    return high


def consistency(share: float, d: int) -> float:
    """What the scatter of the nearest ``share`` of normal data is multiplied by to be that of all."""
    return share / chi2_share(chi2_quantile(share, d), d + 2)


def let(value: Column, body) -> Column:
    """``body`` of a lambda variable bound to ``value``, which is thus evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spread_spaces(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", text)


def _repeat_words(words: Column) -> Column:
    """Words covered by windows of five that occur at least twice; windows compare by 64-bit hash."""

    def covered(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        near = lambda s, k: F.coalesce(F.get(s, k)["h"], F.lit(None).cast("long"))
        twice = let(ranked, lambda s: F.transform(F.filter(s, lambda x, k: F.coalesce(x["h"] == near(s, k + 1), F.lit(False)) | F.coalesce((k > 0) & (x["h"] == near(s, k - 1)), F.lit(False))), lambda x: x["i"]))
        gaps = let(F.sort_array(twice), lambda p: F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW)))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW)))))
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))


def statistics(docs: DataFrame, text_col: str = "text") -> Column:
    """A struct of the counts of one text; a null text counts as empty."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.rlike(x, F.lit("[^\\x20\\x09-\\x0D]")))

        def counts(parts: Column, held: Column) -> Column:
            words = F.array_remove(parts, "")
            return let(
                words,
                lambda w: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    (F.length(t) - F.size(parts) + 1).cast("long").alias("word_chars"),
                    F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                    F.size(held).cast("long").alias("n_lines"),
                    (F.size(held) - F.size(F.array_distinct(held))).cast("long").alias("n_dup_lines"),
                    _repeat_words(w).alias("n_repeat_words"),
                    F.regexp_count(t, F.lit("\\p{Lu}")).cast("long").alias("n_capitals"),
                    F.regexp_count(t, F.lit("[.,;:!?]")).cast("long").alias("n_marks"),
                ),
            )

        return let(F.split(_spread_spaces(t), " ", -1), lambda parts: let(lines, lambda held: counts(parts, held)))

    return let(text, of)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


# --- minimum covariance determinant -------------------------------------------------------


def _pairs(d: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(d) for j in range(i + 1)]


def _levels(df: DataFrame, *levels: dict[str, str]) -> DataFrame:
    """``df`` with columns from SQL, level by level; the columns of a level may use those before it."""
    for level in levels:
        df = df.selectExpr("*", *(f"{sql} AS {name}" for name, sql in level.items()))
    return df


def _cholesky(d: int) -> list[dict[str, str]]:
    """Levels of columns l{i}{j} of the lower triangle of the scatter c{i}{j}, by elimination."""
    out = []
    for j in range(d):
        rest = lambda i: f"c{i}{j}" + "".join(f" - u{i}{k} * u{j}{k} / u{k}{k}" for k in range(j))  # noqa: E731, B023
        out.append({f"u{i}{j}": f"greatest({rest(i)}, 1e-24D)" if i == j else rest(i) for i in range(j, d)})
    return [*out, {f"l{i}{j}": f"u{i}{j} / sqrt(u{j}{j})" for i, j in _pairs(d)}]


def _distance(names: list[str], upward: tuple[bool, ...] | None = None) -> list[dict[str, str]]:
    """Levels of columns z{i} of the whitened vector, then the squared Mahalanobis distance d2.

    Of ``upward`` statistics, values below the location count as the location.
    """
    out = []
    for i, name in enumerate(names):
        above = f"greatest({name} - m{i}, 0D)" if upward and upward[i] else f"{name} - m{i}"
        out.append({f"z{i}": f"({above}" + "".join(f" - l{i}{k} * z{k}" for k in range(i)) + f") / l{i}{i}"})
    return [*out, {"d2": " + ".join(f"z{i} * z{i}" for i in range(len(names)))}]


def _estimate(sums: DataFrame, keys: list[str], floors: list[float], prior: float, factor: float = 1.0) -> DataFrame:
    """Location and triangle of the scatter, times ``factor``, from n, s{i} and p{i}{j}; the logarithm of its determinant.

    The scatter is drawn toward the diagonal of least variances, as if ``prior`` documents with
    that scatter belonged to the group; so constant statistics and tiny groups keep a
    determinant above zero.
    """
    d = len(floors)

    def scatter(i: int, j: int) -> str:
        spread = f"p{i}{j} - n * m{i} * m{j}"
        if i != j:
            return f"{factor!r}D * ({spread}) / (n + {prior!r}D)"
        return f"({factor!r}D * greatest({spread}, 0D) + {prior * floors[i] ** 2!r}D) / (n + {prior!r}D) + {floors[i] ** 2!r}D"

    made = _levels(sums, {f"m{i}": f"s{i} / n" for i in range(d)}, {f"c{i}{j}": scatter(i, j) for i, j in _pairs(d)}, *_cholesky(d), {"det": _log_determinant(d)})
    return made.select(*keys, *_held(d))


def _held(d: int) -> list[str]:
    return [*(f"m{i}" for i in range(d)), *(f"l{i}{j}" for i, j in _pairs(d)), "det"]


def _log_determinant(d: int) -> str:
    return "round(" + " + ".join(f"2 * ln(l{i}{i})" for i in range(d)) + ", 9)"


def _sums(names: list[str]) -> list[Column]:
    d = len(names)
    return [
        F.count("*").alias("n"),
        *(F.sum(names[i]).alias(f"s{i}") for i in range(d)),
        *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}{j}") for i, j in _pairs(d)),
    ]


def _concentrate(binned: DataFrame, keys: list[str], names: list[str], share: float, floors: list[float], prior: float) -> DataFrame:
    """The estimate from the nearest ``share`` of each group, whole bins at a time."""
    sums = binned.groupBy(*keys, "bin").agg(*_sums(names))
    ordered = Window.partitionBy(*keys).orderBy("bin")
    before = F.coalesce(F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sums.withColumn("before", before).withColumn("all", F.sum("n").over(Window.partitionBy(*keys))).filter(F.col("before") < share * F.col("all"))
    totals = [c for c in sums.columns if c not in (*keys, "bin")]
    return _estimate(kept.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in totals)), keys, floors, prior, consistency(share, len(names)))


def _few(df: DataFrame, keys: list[str]) -> bool:
    """Whether the groups are so few that what is known of them can be broadcast."""
    return df.select(*keys).distinct().limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS


def _starts(df: DataFrame, keys: list[str], names: list[str], floors: list[float], prior: float) -> DataFrame:
    """Three estimates of each group, by ``start``: the medians with the least deviations, the
    medians with the deviations of the middle half, and the plain mean and scatter."""
    d = len(names)
    quarters = df.groupBy(*keys).agg(*(F.percentile_approx(n, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, n in enumerate(names)))
    out = [_estimate(df.groupBy(*keys).agg(*_sums(names)), keys, floors, prior).withColumn("start", F.lit(2))]
    for k, deviation in enumerate(("{f!r}D", "greatest((q{i}[2] - q{i}[0]) / 1.349D, {f!r}D)")):
        triangle = {f"l{i}{j}": deviation.format(i=i, f=floors[i]) if i == j else "0D" for i, j in _pairs(d)}
        made = _levels(quarters, {f"m{i}": f"q{i}[1]" for i in range(d)} | triangle, {"det": _log_determinant(d)})
        out.append(made.select(*keys, *_held(d), F.lit(k).alias("start")))
    return reduce(DataFrame.unionByName, out)


def mcd(df: DataFrame, keys: list[str], names: list[str], floors: list[float], share: float = 0.75, prior: float = 50.0, few: bool | None = None) -> DataFrame:
    """One row per group: location m{i}, the triangle l{i}{j} of the scatter and its log determinant.

    Every start takes ``START_STEPS`` concentration steps, none of which can raise the determinant by
    more than the width of a bin; of ties the first start counts. The best of each group goes on until
    no determinant moves; a reweighting step ends it. Estimates are broadcast if the groups are ``few``.
    """
    few = _few(df, keys) if few is None else few
    near = lambda p: _levels(df.join(F.broadcast(p) if few else p, keys), *_distance(names))
    binned = lambda p: near(p).withColumn("bin", F.floor(F.log1p("d2") * BINS))
    params = written(_starts(df, keys, names, floors, prior))
    for _ in range(START_STEPS):
        last, params = params, written(_concentrate(binned(params), [*keys, "start"], names, share, floors, prior))
        release(df.sparkSession, last, times=1)
    best = params.groupBy(*keys).agg(F.min_by(F.struct(*_held(len(names))), F.struct("det", "start")).alias("best"))
    params = written(best.select(*keys, "best.*"))
    for _ in range(MOST_STEPS):
        last, params = params, written(_concentrate(binned(params), keys, names, share, floors, prior))
        moved = params.join(last.select(*keys, F.col("det").alias("was")), keys).agg(F.max(F.abs(F.col("det") - F.col("was")))).first()[0]
        release(df.sparkSession, last, times=1)
        if (moved or 0.0) <= STILL:
            break
    within = 0.975
    inner = near(params).filter(F.col("d2") <= chi2_quantile(within, len(names)))
    return written(_estimate(inner.groupBy(*keys).agg(*_sums(names)), keys, floors, prior, consistency(within, len(names))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), share: float = 0.75, tail: float = TAIL) -> DataFrame:
    """One row per document: its counts, base_failed, d2 and kept.

    A document is rejected if its squared distance d2 is beyond the chi-square quantile that leaves
    ``tail``; few symbols or repeats never count against it. Ties in distance fall in one bin and are
    taken together. Documents that fail the base rules are rejected and take no part in the estimates, nor have a
    d2. A null in a group column is a group of its own. Rows that repeat an id are judged each. A
    text without words fails the base rules; an empty table gives no rows. Only the named columns
    are read, so others may have any name.
    """
    keys = [f"g{i}" for i in range(len(group_cols))]
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(k) for c, k in zip(group_cols, keys, strict=True)),
        statistics(docs, text_col).alias("s"),
    )
    counted = slim.select("doc_id", *keys, "s.*").withColumn("base_failed", base_failed())
    names, floors = [f[0] for f in FEATURES], [f[2] for f in FEATURES]
    table = written(_levels(counted, {name: f"round({sql}, 9)" for name, sql, *_ in FEATURES}))
    judged = table.filter(~F.col("base_failed")).select(*keys, *names)
    few = _few(judged, keys)
    params = mcd(judged, keys, names, floors, share, few=few)
    scored = _levels(table.join(F.broadcast(params) if few else params, keys, "left"), *_distance(names, tuple(f[3] for f in FEATURES)))
    cutoff = chi2_quantile(1 - tail, len(names))
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round(d2, 6).alias("d2"), (~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).alias("kept"),
    )
