"""Quality rules: robust multivariate outliers, in DataFrame operations only.

Each document becomes a vector of transformed text statistics. For each language and source, centre and covariance are
estimated by minimum covariance determinant: from the coordinatewise median and MAD, concentration steps re-estimate
both from the ``keep`` part of the rows with the smallest Mahalanobis distances, until the determinants stop falling.
A document is rejected if its distance exceeds the chi-square quantile at 1 - ``alpha``.

Groups under ``min_rows`` rows are pooled within their language, then overall; if that pool is still smaller, it gets
no verdict. Statistics are fixed-point integers, so that sums are exact and verdicts don't depend on task order.

Null or empty texts have no words and fail the base rule; null languages and sources are groups of their own; repeated
rows count as often as they come; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, Scratch, let

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Statistics are rounded to this part of a unit.
UNIT = 256
#: Least standard deviations, in the statistics' own units; a statistic that is constant in most rows has one too.
FLOORS = {"words": 0.5, "length": 0.1, "symbols": 0.5, "capitals": 0.4, "shouts": 0.5, "repeats": 0.8, "variety": 0.1, "lines": 0.8}
NAMES = list(FLOORS)
#: Up to so many groups, their estimates are broadcast (under 1 KB each); beyond it they are joined by shuffle.
BROADCAST_GROUPS = 20000


def chi2_cdf(x: float, p: float) -> float:
    """P(chi-square with p degrees of freedom <= x), by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = p / 2, x / 2
    term = total = 1 / a
    for n in range(1, 2000):
        term *= x / (a + n)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(q: float, p: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < q else (lo, mid)
    return hi


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words inside WINDOW-word windows that come twice or more; hashes has one entry for each window."""
    def covered(s: Column) -> Column:
        same = lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))
        at = F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
        spans = let(at, lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered)).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, with counts of each whole text (null: none)."""
    plain = docs.withColumn("text", F.coalesce("text", F.lit("")))
    less = lambda chars: (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")
    words = plain.withColumn("_words", F.array_remove(F.split("text", SPACE_CLASS), ""))
    n = F.size("_words")
    lines = words.withColumn(
        "_hashes",
        F.when(
            n >= WINDOW,
            F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW))))
        ).otherwise(F.expr("cast(array() as array<bigint>)"))
    )
    lines = lines.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return lines.select(
        *[c for c in docs.columns if c != "text"],
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE_CLASS, "")).cast("long").alias("word_chars"),
        less(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words"), F.col("_hashes")).alias("n_repeat_words"),
        less("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        less("!?").alias("n_shouts"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
    )


def vectors(stats: DataFrame) -> DataFrame:
    """stats with ``x``, the transformed statistics as an array of whole numbers of 1 / UNIT."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    rate = lambda a, b: F.log1p(F.col(a) * 100.0 / b)
    made = {
        "words": F.log1p("n_words"),
        "length": F.log(chars / n),
        "symbols": rate("n_symbols", n),
        "capitals": rate("n_capitals", chars),
        "shouts": rate("n_shouts", n),
        "repeats": rate("n_repeat_words", n),
        "variety": F.log(F.greatest("n_distinct", F.lit(1)) / n),
        "lines": rate("n_dup_lines", n),
    }
    return stats.withColumn("x", F.array(*[F.round(made[k] * UNIT).cast("int") for k in NAMES]))


def _with_groups(v: DataFrame, min_rows: int) -> DataFrame:
    """v with ``g``: its language and source, or the pool that small groups go to; null if the last pool is small too."""
    named = v.withColumns({"_l": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), "_s": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))})
    sizes = named.groupBy("_l", "_s").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.filter(F.col("n") < min_rows)
    by_lang = small.groupBy("_l").agg(F.sum("n").alias("n_lang"))
    rest = by_lang.filter(F.col("n_lang") < min_rows).agg(F.sum("n_lang").alias("n_all"))
    g = F.when(
        F.col("n") >= min_rows,
        F.to_json(F.struct("_l", "_s"))
    ).when(F.col("n_lang") >= min_rows, F.to_json(F.struct("_l"))).when(F.col("n_all") >= min_rows, F.lit("{}"))
    keys = sizes.join(by_lang, "_l", "left").join(F.broadcast(rest)).select("_l", "_s", g.alias("g"))  # rest is one row
    keys = F.broadcast(keys) if sizes.count() <= BROADCAST_GROUPS else keys  # else AQE splits a hot group's join
    return named.join(keys, ["_l", "_s"], "left").drop("_l", "_s")


def _row(i: int | Column) -> int | Column:
    """Where row i of a lower triangle begins, the rows standing end to end in an array."""
    return i * (i + 1) // 2 if isinstance(i, int) else F.floor(i * (i + 1) / 2).cast("int")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)


def _cholesky(s: Column, p: int) -> Column:
    """The lower triangle of the Cholesky factor of a covariance, both as arrays."""
    rows = F.array(*[F.lit(i) for i in range(p) for _ in range(i + 1)])
    columns = F.array(*[F.lit(j) for i in range(p) for j in range(i + 1)])

    def add(low: Column, t: Column) -> Column:
        i, j = F.get(rows, t), F.get(columns, t)
        rest = F.get(s, t) - _dot(F.slice(low, _row(i) + 1, j), F.slice(low, _row(j) + 1, j))
        side = rest / F.get(low, _row(j) + j)
        return F.concat(low, F.array(F.when(i == j, F.sqrt(F.greatest(rest, F.lit(1e-9)))).otherwise(side)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(p * (p + 1) // 2 - 1)), F.expr("cast(array() as array<double>)"), add)


def _half_log_det(low: Column, p: int) -> Column:
    return sum((F.log(F.get(low, F.lit(_row(i) + i))) for i in range(p)), F.lit(0.0))


def _distance(p: int) -> Column:
    """The squared Mahalanobis distance of x from the centre m with the Cholesky factor low."""
    x, m, low = F.col("x"), F.col("m"), F.col("low")

    def add(y: Column, i: Column) -> Column:
        gap = F.get(x, i) / UNIT - F.get(m, i) - _dot(F.slice(low, _row(i) + 1, i), y)
        return F.concat(y, F.array(gap / F.get(low, _row(i) + i)))

    whitened = F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), F.expr("cast(array() as array<double>)"), add)
    return F.aggregate(whitened, F.lit(0.0), lambda t, v: t + v * v)


def _coordinate_medians(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """(g, out): the medians of the places of an array column in each group."""
    each = rows.select("g", F.posexplode(value).alias("i", "v")).groupBy("g", "i").agg(F.percentile("v", 0.5).alias("v"))
    return each.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias(out))


def mcd_estimates(v: DataFrame, tmp: Scratch, p: int, keep: float = 0.75) -> DataFrame:
    """A row for each group g of v(g, x): centre m and lower Cholesky factor low of the robust covariance, as arrays.

    A group takes steps as long as its determinant falls; one whose determinant doesn't keeps its last estimate. Every
    step but a group's last makes half the log determinant, which the floors bound, smaller by 1e-6, so all groups end.
    """
    floor = [FLOORS[k] for k in NAMES[:p]]
    places = [(i, j) for i in range(p) for j in range(i + 1)]
    rows = tmp.save(v.filter("g IS NOT NULL").select("g", "x"), "vectors")
    med = tmp.save(_coordinate_medians(rows, F.col("x"), "c"), "medians")
    joins = (lambda df: F.broadcast(df)) if med.count() <= BROADCAST_GROUPS else (lambda df: df)
    apart = F.zip_with("x", "c", lambda a, b: F.abs(a - b))
    dev = _coordinate_medians(rows.join(joins(med), "g"), apart, "d")
    wide = [F.pow(F.greatest(F.get("d", F.lit(i)) * 1.4826 / UNIT, F.lit(floor[i])), 2) for i in range(p)]
    start = F.array(*[wide[i] if i == j else F.lit(0.0) for i, j in places])
    est = med.join(dev, "g").select("g", F.transform("c", lambda c: c / UNIT).alias("m"), _cholesky(start, p).alias("low"))
    est = tmp.save(est.withColumn("h", _half_log_det(F.col("low"), p)), "start")
    scale = keep / chi2_cdf(chi2_quantile(keep, p), p + 2)  # so that the covariance of the kept part fits normal rows
    x = [F.get("x", F.lit(i)).cast("long") for i in range(p)]
    sums = [F.sum(x[i]).alias(f"t{i}") for i in range(p)] + [F.sum(x[i] * x[j]).alias(f"t{i}_{j}") for i, j in places]
    mean = [F.col(f"t{i}") / F.col("n") for i in range(p)]
    cov = [(F.col(f"t{i}_{j}") / F.col("n") - mean[i] * mean[j]) / UNIT**2 * scale + (floor[i] ** 2 if i == j else 0.0) for i, j in places]
    done: list[DataFrame] = []
    first = True
    while True:
        at = rows.join(joins(est.select("g", "m", "low")), "g")
        at = tmp.save(at.select("g", "x", F.floor(F.log1p(_distance(p)) * 1024).cast("int").alias("b")), "distances")
        cut = at.groupBy("g").agg(F.ceil(F.percentile("b", keep)).alias("cut"))
        inner = at.join(joins(cut), "g").filter("b <= cut").groupBy("g").agg(F.count(F.lit(1)).alias("n"), *sums)
        new = inner.select("g", F.array(*[c / UNIT for c in mean]).alias("m"), F.array(*cov).alias("s"))
        new = new.select("g", "m", _cholesky(F.col("s"), p).alias("low")).withColumn("h", _half_log_det(F.col("low"), p))
        # The start's determinant is of medians and MADs, not of a step.
        falls = F.lit(True) if first else F.col("was.h") - F.col("h") >= 1e-6
        last = est.select("g", F.struct("m", "low", "h").alias("was"))
        step = tmp.save(new.join(last, "g").withColumn("falls", falls), "step")
        tmp.drop(at)
        first = False
        done.append(step.filter("NOT falls").select("g", "was.*"))
        est = step.filter("falls").select("g", "m", "low", "h")
        if est.isEmpty():
            return functools.reduce(DataFrame.unionByName, done)


def quality_verdicts(docs: DataFrame, alpha: float = 1e-6, keep: float = 0.75, min_rows: int = 64, min_words: int = 20, most_repeats: int = 30, tag: Column | None = None) -> DataFrame:
    """docs(doc_id, text, lang, source) -> doc_id, the counts, base_failed, pool, distance, kept, and the column ``tag`` if given.

    pool names the rows that a document was judged among, as JSON of language and source, of language, or of nothing;
    null, as the distance, where they are too few for a verdict, and such a document is kept if the base rule keeps it.
    """
    spark, p = docs.sparkSession, len(NAMES)
    tmp = Scratch(spark, "quality")
    stats = tmp.save(
        vectors(text_statistics(docs.select("doc_id", "text", "lang", "source", *([] if tag is None else [tag.alias("tag")])))),
        "statistics"
    )
    grouped = _with_groups(stats, min_rows)
    est = mcd_estimates(grouped, tmp, p, keep)
    tmp.settle()
    est = F.broadcast(est) if est.count() <= BROADCAST_GROUPS else est
    far = grouped.join(est.select("g", "m", "low"), "g", "left").withColumn("d2", F.when(F.col("m").isNotNull(), _distance(p)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    limit = chi2_quantile(1 - alpha, p)
    return far.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.col("g").alias("pool"),
        F.col("d2").alias("distance"),
        (~failed & (F.coalesce("d2", F.lit(0.0)) <= limit)).alias("kept"),
        *([] if tag is None else ["tag"])
    )
