"""Quality rules with robust multivariate outliers, in DataFrame functions alone.

Base rules come from counts over a whole text. A document that passes them is judged by its transformed statistics
against a minimum-covariance-determinant (MCD) estimate of its own language and source: from two robust starts, STEPS
concentration steps keep the share H of rows with the least Mahalanobis distance, re-estimate mean and covariance, and
the start whose covariance has the lesser determinant wins. A document beyond the cut-off is rejected.

The covariance whose determinant is compared is the regularised one: the squares of the FEATURES' floors are added to its
diagonal, so a statistic that is constant in most rows (say, no repeated line) doesn't make every small deviation an
outlier, and every matrix has an inverse. A group's estimate is drawn towards that of its language as if PRIOR_ROWS rows
of it were added, and a language's towards that of all rows: one rule for groups of every size, by which a group of
a thousand rows is judged by itself and one of a single row by its language. All sums are aggregates by group with partial
sums before the shuffle; what is kept by group is one row of a mean and a covariance.

Defined cases: a null text has no words and fails the base rules; null language and source are groups like others;
repeated rows are judged alike and all count in the estimates; rows at equal distance to the H-th are all kept in a step;
a very long text is counted whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, bounded, documents, settle

#: Base rules: fewest words, and the greatest share of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: Share of rows that an MCD estimate rests on, concentration steps, and the rows that the larger set's estimate counts for.
H, STEPS, PRIOR_ROWS = 0.75, 4, 50
#: Of the chi-squared distribution with 5 degrees of freedom: its 0.75 quantile, its median, and the factor that makes
#: the covariance of the H nearest rows consistent, H / P(chi2 with 7 degrees <= that quantile).
CHI2_H, CHI2_MEDIAN, CONSISTENCY = 6.6257, 4.3515, 0.75 / 0.5308
#: Squared Mahalanobis distance beyond which a document goes: chi-squared with 5 degrees of freedom at 1 - 1e-9, about.
CUT = 50.0
#: Transformed statistics and the least standard deviation that each is taken to have.
FEATURES = {"ln_words": 0.5, "ln_word_length": 0.06, "symbol_rate": 0.05, "dup_line_rate": 0.12, "repeat_rate": 0.12}
#: At most so many distinct repeated windows are looked up one by one; texts with more are sorted instead.
LOOKUPS = 24


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _repeated_positions(words: Column, grams: Column, ordered: Column) -> Column:
    """Start positions of the windows that occur twice or more, ascending; ``ordered`` is ``grams`` sorted."""
    twice = F.array_distinct(F.filter(ordered, lambda x, i: (i > 0) & (x == F.get(ordered, i - 1))))
    look = lambda d: F.filter(F.sequence(F.lit(0), F.size(grams) - 1), lambda i: F.array_contains(d, F.get(grams, i)))
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    near = lambda t: F.filter(t, lambda x, k: ((k > 0) & (x["g"] == F.get(t, k - 1)["g"])) | F.coalesce(x["g"] == F.get(t, k + 1)["g"], F.lit(False)))
    by_sort = lambda: F.sort_array(F.flatten(F.transform(F.array(pairs), lambda t: F.transform(near(t), lambda x: x["i"]))))
    none = F.expr("cast(array() as array<int>)")
    bound = F.transform(F.array(twice), lambda d: F.when(F.size(d) == 0, none).when(F.size(d) <= LOOKUPS, look(d)).otherwise(by_sort()))
    return F.get(bound, F.lit(0))


def statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Counts of each text beside doc_id, lang and source, or with ``carry`` beside the whole row too; no shuffle."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, BLANK), lambda w: w != "")
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    out = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), text.alias("text"), words.alias("words"), *whole)
    grams = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(WINDOW)])))
    out = out.withColumn("grams", F.coalesce(grams, F.expr("cast(array() as array<bigint>)"))).withColumn("ordered", F.sort_array("grams"))
    out = out.withColumn("lines", _lines_with_words(F.col("text")))
    at = _repeated_positions(F.col("words"), F.col("grams"), F.col("ordered"))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(at, start, lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n")), lambda s: s["n"])
    return out.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        F.expr(r"regexp_count(text, '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("grams") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        *(["row"] if carry else []),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def transformed(stats: DataFrame) -> DataFrame:
    """The FEATURES of each row, each near to symmetric on ordinary text."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rate = lambda c, m: F.sqrt(F.col(c) / m)
    return stats.withColumns({
        "ln_words": F.log(n),
        "ln_word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "symbol_rate": rate("n_symbols", n),
        "dup_line_rate": rate("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))),
        "repeat_rate": rate("n_repeat_words", n),
    })


# ---------------------------------------------------------------- estimates
X = list(FEATURES)
_PAIRS = [(a, b) for a in range(len(X)) for b in range(a + 1)]


_MEANS, _COVS = [f"m{a}" for a in range(len(X))], [f"c_{a}_{b}" for a, b in _PAIRS]


def _factor(df: DataFrame, keep: list[str]) -> DataFrame:
    """Adds to means m0.. and covariances c_a_b the inverse i_a_b of the Cholesky factor, and the log-determinant."""
    for a, b in _PAIRS:
        rest = F.col(f"c_{a}_{b}")
        for k in range(b):
            rest = rest - F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}")
        # a regularised matrix never comes under the floor but by rounding; that of a start may
        df = df.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(rest, F.lit(FEATURES[X[a]] ** 2))) if a == b else rest / F.col(f"l_{b}_{b}"))
    for a in range(len(X)):
        for b in range(a + 1):
            below = sum((F.col(f"l_{a}_{k}") * F.col(f"i_{k}_{b}") for k in range(b, a)), F.lit(0.0))
            df = df.withColumn(f"i_{a}_{b}", (F.lit(1.0) if a == b else -below) / F.col(f"l_{a}_{a}"))
    det = sum((F.log(F.col(f"l_{a}_{a}")) for a in range(len(X))), F.lit(0.0))
    return df.select(*keep, *_MEANS, *_COVS, *[f"i_{a}_{b}" for a, b in _PAIRS], det.alias("ln_det"))


def _distance() -> Column:
    """Squared Mahalanobis distance of a row to the estimate beside it: a sum of squares of few terms each."""
    off = [F.col(x) - F.col(f"m{a}") for a, x in enumerate(X)]
    z = [sum((F.col(f"i_{a}_{b}") * off[b] for b in range(a)), F.col(f"i_{a}_{a}") * off[a]) for a in range(len(X))]
    return sum((F.pow(v, F.lit(2.0)) for v in z[1:]), F.pow(z[0], F.lit(2.0)))


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and regularised covariance by group, from sums; covariances are made consistent with the whole group."""
    sums = [F.avg(x).alias(f"m{a}") for a, x in enumerate(X)] + [F.avg(F.col(X[a]) * F.col(X[b])).alias(f"s_{a}_{b}") for a, b in _PAIRS]
    got = rows.groupBy(*keys).agg(*sums)
    cov = {f"c_{a}_{b}": CONSISTENCY * (F.col(f"s_{a}_{b}") - F.col(f"m{a}") * F.col(f"m{b}")) + (FEATURES[X[a]] ** 2 if a == b else 0.0) for a, b in _PAIRS}
    return _factor(got.withColumns(cov), keys)


#: Greatest number of group estimates that are broadcast, under 300 bytes each; beyond it rows and estimates are shuffled.
BROADCAST_GROUPS = 100_000


def _with_estimates(rows: DataFrame, est: DataFrame, keys: list[str], few: bool) -> DataFrame:
    return rows.join(F.broadcast(est) if few else est, keys)


def mcd(rows: DataFrame) -> DataFrame:
    """One estimate for each ``grp`` of rows with the FEATURES: mean and regularised covariance.

    Starts: 0, medians and quartile spreads with no correlation; 1, median and the co-movement of the signs around it.
    """
    quart = [F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q{a}") for a, x in enumerate(X)]
    box = settle(rows.groupBy("grp").agg(*quart), "quartiles")
    few = box.count() <= BROADCAST_GROUPS
    spread = {a: F.greatest((F.col(f"q{a}")[2] - F.col(f"q{a}")[0]) / 1.349, F.lit(FEATURES[x])) for a, x in enumerate(X)}
    box = box.select("grp", *[F.col(f"q{a}")[1].alias(f"m{a}") for a in range(len(X))], *[spread[a].alias(f"d{a}") for a in range(len(X))])
    diag = {f"c_{a}_{b}": (F.col(f"d{a}") ** 2 if a == b else F.lit(0.0)) for a, b in _PAIRS}
    plain = _factor(box.withColumns(diag), ["grp"]).withColumn("start", F.lit(0))
    signs = _with_estimates(rows.select("grp", *X), box, ["grp"], few)
    scaled = [F.least(F.greatest((F.col(x) - F.col(f"m{a}")) / F.col(f"d{a}"), F.lit(-1.5)), F.lit(1.5)) for a, x in enumerate(X)]
    co = signs.groupBy("grp").agg(*[F.avg(scaled[a] * scaled[b]).alias(f"r_{a}_{b}") for a, b in _PAIRS])
    signed = {f"c_{a}_{b}": F.col(f"d{a}") * F.col(f"d{b}") * (F.lit(1.0) if a == b else F.col(f"r_{a}_{b}") / F.sqrt(F.greatest(F.col(f"r_{a}_{a}") * F.col(f"r_{b}_{b}"), F.lit(1e-6)))) for a, b in _PAIRS}
    robust = _factor(_with_estimates(box, co, ["grp"], False).withColumns(signed), ["grp"]).withColumn("start", F.lit(1))
    est = settle(plain.unionByName(robust), "starts")
    for _ in range(STEPS):
        near = _with_estimates(rows.select("grp", *X), est, ["grp"], few).withColumn("d2", _distance()).select("grp", "start", "d2", *X)
        edge = near.groupBy("grp", "start").agg(F.percentile_approx("d2", H, 1000).alias("edge"))
        edged = est.join(edge, ["grp", "start"])
        inside = _with_estimates(rows.select("grp", *X), edged, ["grp"], few).where(_distance() <= F.col("edge")).select("grp", "start", *X)
        est = settle(_moments(inside, ["grp", "start"]), "step")
    return est.groupBy("grp").agg(F.min_by(F.struct(*_MEANS, *_COVS), F.struct("ln_det", "start")).alias("e")).select("grp", "e.*")


def _group() -> Column:
    """Language and source as one key; null is a value like others."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return F.concat_ws("\t", named("lang"), named("source"))


def _drawn(own: DataFrame, wider: DataFrame, key: str) -> DataFrame:
    """Estimates drawn towards those of a wider set, by their rows ``n`` against PRIOR_ROWS; both have ``key``."""
    theirs = wider.select(key, *[F.col(c).alias(f"w_{c}") for c in _MEANS + _COVS])
    share = F.col("n") / (F.col("n") + PRIOR_ROWS)
    both = own.join(theirs, key)
    return both.select(*[c for c in own.columns if c not in _MEANS + _COVS], *[(share * F.col(c) + (1 - share) * F.col(f"w_{c}")).alias(c) for c in _MEANS + _COVS])


def estimates(stats: DataFrame) -> DataFrame:
    """An estimate for each group (``own``) of settled statistics: its own, its language's and that of all rows, drawn together."""
    rows = transformed(stats.where(~F.col("base_failed"))).withColumn("own", _group())
    sizes = settle(rows.groupBy("own").agg(F.count("*").alias("n")), "sizes")
    groups = sizes.select(F.col("own").alias("grp"), F.concat(F.lit("lang\t"), F.split("own", "\t")[0]).alias("lang"), F.lit("all").alias("all"), "n")
    fit = rows.select(F.explode(F.array("own", F.concat(F.lit("lang\t"), F.split("own", "\t")[0]), F.lit("all"))).alias("grp"), *X)
    est = settle(mcd(fit), "mcd")
    every = est.where("grp = 'all'").select(F.col("grp").alias("all"), *_MEANS, *_COVS)
    langs = groups.groupBy("lang", "all").agg(F.sum("n").alias("n")).join(est, F.col("lang") == F.col("grp")).drop("grp")
    langs = _drawn(langs, every, "all").drop("n")
    own = groups.join(est, "grp").withColumnRenamed("grp", "own")
    return settle(_factor(_drawn(own, langs, "lang"), ["own"]).drop(*_COVS, "ln_det"), "estimates")


def verdicts(stats: DataFrame, est: DataFrame) -> DataFrame:
    """``stats`` with distance2 (null only if no row of the group passes the base rules) and kept."""
    judged = transformed(stats).withColumn("own", _group()).join(bounded(est, BROADCAST_GROUPS), "own", "left").withColumn("distance2", _distance())
    return judged.select(*stats.columns, "distance2", (~F.col("base_failed") & ~F.coalesce(F.col("distance2") > CUT, F.lit(False))).alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, distance2 and kept of every document."""
    stats = settle(statistics(docs), "statistics")
    return verdicts(stats, estimates(stats))


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject.

    The counts are worked out twice, once for the estimates and once beside the row: texts are never shuffled.
    """
    est = estimates(settle(statistics(docs), "statistics"))
    judged = verdicts(statistics(docs, carry=True), est)
    # an explode and no filter: a filter would be pushed down, and with it a second copy of all that it rests on
    return judged.select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select("row.*")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document; then its squared distance."""
    out = judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")
