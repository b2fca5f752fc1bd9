"""Quality rules with robust multivariate outliers, by DataFrame functions only.

Base statistics of each text give a vector of transformed statistics. For each language and source, each language, and all rows the minimum covariance determinant (MCD) is
estimated: the mean and covariance of the share of rows whose ellipsoid is smallest. From each of three starts - medians and spreads, all rows' moments, the covariance of directions from
the median - concentration steps are taken: distances of all rows, the share `core` with the least, mean and covariance of those. After two steps the start with the least determinant
goes on until that falls no further.

A group's estimate is blended with its language's, and that with all rows', in proportion to its rows: m of them weigh m / (m + PRIOR_ROWS). So a group is
judged by its own estimate the more the larger it is, and none is too small to be judged. A row whose Mahalanobis distance from the blend is beyond the limit is an outlier.

Statistics are held as integers, in steps of 1/SCALE, and sums of them are exact; so a step's estimate doesn't depend on how rows are
dealt to tasks. Order statistics come from counts in narrow bins, found through wide ones, so no group's rows need to meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_CLASS, SPACES, discard, small_join, text_of, written

SCALE = 1000
#: Bins of a distance for each doubling, and narrow bins in a wide one.
BINS_PER_DOUBLING, WIDE_BIN = 64, 64
#: Rows of its own at which a group's estimate weighs as much as what stands above it.
PRIOR_ROWS = 50
#: Steps that every start takes; after them the one with the least determinant goes on, as in the published fast algorithm.
SHORT_STEPS = 2
#: A determinant that falls by less than this part has stopped falling.
FALL = 1e-3
#: The transformed statistics: name, expression, and a spread below which a group's own spread is not taken for real.
#: Square roots of shares even out their spread; the floors keep a text with one symbol from standing far outside a group that has none.
FEATURES = (
    ("word_length", "ln(greatest(word_chars, 1) / greatest(n_words, 1))", 0.10),
    ("symbols", "sqrt(n_symbols / greatest(word_chars, 1))", 0.06),
    ("repeats", "sqrt(n_repeat_words / greatest(n_words, 1))", 0.12),
    ("dup_lines", "sqrt(n_dup_lines / greatest(n_lines, 1))", 0.15),
    ("variety", "ln(greatest(n_distinct, 1) / pow(greatest(n_words, 1), 0.85))", 0.15),
)


def repeat_words(words: Column, n: int = 5) -> Column:
    """Words that lie in an n-word window which the text has twice or more, all occurrences counted.

    Windows are compared by 64-bit hashes. A text whose windows all differ ends after one sort of the hashes; in another the windows that
    repeat are found by one sort of (hash, position), and their union is measured from position to position. Nothing is quadratic in the text."""
    count = F.size(words)

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.when(F.size(w) >= n, F.transform(at, lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<bigint>"))

    def repeated(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def doubled(s: Column) -> Column:
            last = F.size(s)
            twice = F.filter(s, lambda x, i: ((i > 0) & (F.element_at(s, F.greatest(i, F.lit(1)))["h"] == x["h"])) | ((i + 1 < last) & (F.element_at(s, F.least(i + 2, last))["h"] == x["h"])))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def covered(p: Column) -> Column:
            last = F.size(p)
            return F.aggregate(F.transform(p, lambda x, i: F.when(i + 1 < last, F.least(F.lit(n), F.element_at(p, F.least(i + 2, last)) - x)).otherwise(n)), F.lit(0), lambda a, b: a + b)

        inner = F.transform(F.array(placed), doubled)
        return F.element_at(F.transform(inner, covered), 1)

    def of(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h))

    return F.when(count < n, F.lit(0)).otherwise(F.element_at(F.transform(F.transform(F.array(words), windows), of), 1)).cast("long")


def base_statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_distinct, base_failed. A null text has no words."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), text_of(text).alias("t"))
    inner = F.btrim(F.col("t"), F.lit(SPACES))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    split = slim.select(
        "doc_id", "lang", "source",
        F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_CLASS + "+")).alias("words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    stats = split.select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )
    return stats.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


DIMS = range(len(FEATURES))
CELLS = [(i, j) for i in DIMS for j in DIMS if j >= i]
MEANS, COVARIANCES = [f"mu{i}" for i in DIMS], [f"c{i}_{j}" for i, j in CELLS]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: m, means and covariances of v0.., from exact integer sums."""
    sums = [F.sum(F.col(f"v{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in DIMS]
    sums += [F.sum((F.col(f"v{i}") * F.col(f"v{j}")).cast("decimal(38,0)")).alias(f"q{i}_{j}") for i, j in CELLS]
    total = rows.groupBy(*keys).agg(F.count("*").alias("m"), *sums)
    out = total.select(*keys, "m", *[(F.col(f"s{i}").cast("double") / F.col("m")).alias(f"mu{i}") for i in DIMS], *[F.col(f"q{i}_{j}").cast("double").alias(f"q{i}_{j}") for i, j in CELLS])
    return out.select(*keys, "m", *MEANS, *[(F.col(f"q{i}_{j}") / F.col("m") - F.col(f"mu{i}") * F.col(f"mu{j}")).alias(f"c{i}_{j}") for i, j in CELLS])


def _factored(est: DataFrame) -> DataFrame:
    """est with the Cholesky factor l_i_j of the covariance plus the squared floors on the diagonal, one column at a time, and log_det, the log of its determinant."""
    for i in DIMS:
        for j in range(i + 1):
            a = F.col(f"c{j}_{i}") + (F.lit((FEATURES[i][2] * SCALE) ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                a = a - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            est = est.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(a, F.lit(1e-6))) if i == j else a / F.col(f"l{j}_{j}"))
    return est.withColumn("log_det", sum((2 * F.log(F.col(f"l{i}_{i}")) for i in DIMS), F.lit(0.0)))


def _distances(rows: DataFrame, est: DataFrame, groups: int, keep: list[str], how: str = "inner") -> DataFrame:
    """the columns `keep`, of rows or est, with d2, the squared Mahalanobis distance from the group's estimate, by forward substitution."""
    factor = [f"l{i}_{j}" for i in DIMS for j in range(i + 1)]
    out = small_join(rows, est.select("grp", *[c for c in est.columns if c in keep and c != "grp"], *MEANS, *factor), ["grp"], groups, how)
    for i in DIMS:
        a = F.col(f"v{i}") - F.col(f"mu{i}")
        for k in range(i):
            a = a - F.col(f"l{i}_{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", a / F.col(f"l{i}_{i}"))
    return out.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in DIMS), F.lit(0.0))).select(*keep, "d2")


def _ranked(rows: DataFrame, bin_no: Column, keys: list[str], share: float, name: str) -> DataFrame:
    """Per group the least bin up to which at least `share` of the rows lie. Rows are counted before they meet; the wide bin is found first, so few counts are ever put in order together."""
    bins = rows.groupBy(*keys, bin_no.cast("long").alias("bin")).agg(F.count("*").alias("n")).withColumn("wide", F.floor(F.col("bin") / WIDE_BIN))

    def reached(counts: DataFrame, by: list[str], order: str, before: Column) -> DataFrame:
        upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", before + F.coalesce(F.sum("n").over(upto), F.lit(0)))

    wide = bins.groupBy(*keys, "wide").agg(F.sum("n").alias("n"))
    wide = reached(wide.withColumn("want", F.ceil(F.sum("n").over(Window.partitionBy(*keys)) * share)), keys, "wide", F.lit(0))
    wide = wide.where("before < want and before + n >= want").select(*keys, "wide", "want", F.col("before").alias("ahead"))
    narrow = reached(bins.join(wide, [*keys, "wide"]), keys, "bin", F.col("ahead"))
    return narrow.where("before < want and before + n >= want").select(*keys, F.col("bin").alias(name))


def _distance_bin() -> Column:
    return F.floor(F.log2(1 + F.col("d2")) * BINS_PER_DOUBLING)


def _starts(fit: DataFrame, groups: int) -> DataFrame:
    """grp, start, means and covariances of the three starts."""

    def middles(each: DataFrame, name: str) -> DataFrame:
        long = each.select("grp", F.posexplode(F.array(*[f"v{i}" for i in DIMS])).alias("dim", "v"))
        half = _ranked(long, F.col("v"), ["grp", "dim"], 0.5, "half")
        return half.groupBy("grp").agg(*[F.max(F.when(F.col("dim") == i, F.col("half"))).cast("double").alias(f"{name}{i}") for i in DIMS])

    centre = written(middles(fit, "mu"), "mcd-median")
    away = small_join(fit, centre, ["grp"], groups).select("grp", *[F.abs(F.col(f"v{i}") - F.col(f"mu{i}")).cast("long").alias(f"v{i}") for i in DIMS])
    spread = written(small_join(centre, middles(away, "mad"), ["grp"], groups), "mcd-spread")
    scale = [F.greatest(1.4826 * F.col(f"mad{i}"), F.lit(FEATURES[i][2] * SCALE)) for i in DIMS]
    first = spread.select("grp", F.lit(0).alias("start"), *MEANS, *[(F.pow(1.4826 * F.col(f"mad{i}"), F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in CELLS])
    second = _moments(fit, ["grp"]).select("grp", F.lit(1).alias("start"), *MEANS, *COVARIANCES)
    # directions from the median, in units of the spreads: how far a row lies away doesn't count
    moved = small_join(fit, spread, ["grp"], groups).select("grp", *[((F.col(f"v{i}") - F.col(f"mu{i}")) / scale[i]).alias(f"u{i}") for i in DIMS])
    norm = F.sqrt(sum((F.col(f"u{i}") * F.col(f"u{i}") for i in DIMS), F.lit(0.0)))
    turned = moved.withColumn("norm", norm).select("grp", *[F.when(F.col("norm") > 0, F.round(SCALE * F.col(f"u{i}") / F.col("norm"))).otherwise(0).cast("long").alias(f"v{i}") for i in DIMS])
    turned = _moments(turned, ["grp"]).select("grp", *COVARIANCES)
    third = small_join(spread, turned, ["grp"], groups).select("grp", F.lit(2).alias("start"), *MEANS, *[(F.col(f"c{i}_{j}") * scale[i] * scale[j] * len(DIMS) / SCALE**2).alias(f"c{i}_{j}") for i, j in CELLS])
    return first.unionByName(second).unionByName(third)


def mcd_estimates(fit: DataFrame, core: float = 0.75) -> DataFrame:
    """grp, m (its rows), means, covariances and log_det of the MCD estimate of each group of fit (grp and integers v0...), and unit, by which squared distances are too long.

    A normal sample's core has less spread than the whole: unit makes the median distance the normal one's."""
    rows = written(fit.groupBy("grp").agg(F.count("*").alias("m")), "mcd-sizes")
    groups = rows.count()
    # no determinant yet: a start's own may be below that of any core
    est = written(_factored(_starts(fit, groups)).withColumn("log_det", F.lit(float("inf"))), "mcd-start")
    done: list[DataFrame] = []
    while True:
        starts = groups * 3
        far = _distances(fit, est, starts, ["grp", "start", *[f"v{i}" for i in DIMS]]).withColumn("bin", _distance_bin())
        cut = written(_ranked(far, F.col("bin"), ["grp", "start"], core, "cut"), "mcd-cut")
        step = _factored(_moments(small_join(far, cut, ["grp", "start"], starts).where("bin <= cut"), ["grp", "start"])).drop("m")
        old = est.select("grp", "start", F.col("log_det").alias("old"))
        step = written(small_join(step, old, ["grp", "start"], starts).withColumn("falls", F.col("log_det") < F.col("old") - FALL), "mcd-step")
        discard(cut)
        done.append(step.select("grp", "start", *MEANS, *COVARIANCES, "log_det"))
        if len(done) == SHORT_STEPS:  # of the starts the best goes on
            best = step.groupBy("grp").agg(F.min(F.struct("log_det", "start")).alias("b")).select("grp", F.col("b.start").alias("start"))
            step = small_join(step, best, ["grp", "start"], starts)
        est = step.where("falls").drop("old", "falls")
        if est.isEmpty():
            break
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    least = every.groupBy("grp").agg(F.min(F.struct("log_det", "start", *MEANS, *COVARIANCES)).alias("e")).select("grp", "e.*")
    best = written(_factored(small_join(least.drop("start", "log_det"), rows, ["grp"], groups)), "mcd-best")
    mid = _ranked(_distances(fit, best, groups, ["grp"]), _distance_bin(), ["grp"], 0.5, "mid")
    n = len(FEATURES)
    median = n * (1 - 2 / (9 * n)) ** 3
    unit = F.greatest(F.pow(F.lit(2.0), (F.col("mid") + 0.5) / BINS_PER_DOUBLING) - 1, F.lit(median)) / median
    return written(small_join(best, mid, ["grp"], groups).withColumn("unit", unit), "mcd-estimate")


def mcd_outliers(rows: DataFrame, *, core: float = 0.75, limit: float = 5.5) -> DataFrame:
    """rows (doc_id, lang, source and the base statistics) with `distance` and `outlier`.

    Estimates come from rows that passed the base rules; where none did, distances are null and nothing is an outlier. limit is a robust distance: with
    five statistics a normal row lies beyond 5.5 about once in 70,000, so only texts unlike nearly all others of their kind go."""
    ids = rows.columns
    name = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}), F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})
    valued = rows.select("*", name[0].alias("grp"), name[1].alias("parent"), *[F.round(F.expr(e) * SCALE).cast("long").alias(f"v{i}") for i, (_, e, _) in enumerate(FEATURES)])
    valued = written(valued, "mcd-rows")
    fit = valued.where("not base_failed").select(F.explode(F.array("grp", "parent", F.lit("all"))).alias("grp"), *[f"v{i}" for i in DIMS])
    est = mcd_estimates(fit, core)
    scaled = est.select("grp", "m", *MEANS, *[(F.col(c) * F.col("unit")).alias(c) for c in COVARIANCES])
    groups = est.count()

    def blended(own: DataFrame, above: DataFrame) -> DataFrame:
        """own (grp, parent, ...) moved toward the estimate of its parent; a group without rows of its own has its parent's."""
        up = above.select(F.col("grp").alias("parent"), *[F.col(c).alias(f"up_{c}") for c in MEANS + COVARIANCES])
        both = small_join(own, up, ["parent"], groups)
        w = F.coalesce(F.col("m"), F.lit(0)) / (F.coalesce(F.col("m"), F.lit(0)) + PRIOR_ROWS)
        return both.select("grp", *[(w * F.coalesce(F.col(c), F.lit(0.0)) + (1 - w) * F.col(f"up_{c}")).alias(c) for c in MEANS + COVARIANCES])

    top = scaled.where("grp = 'all'")
    names = written(valued.select("grp", "parent").distinct(), "mcd-names")
    parents = blended(small_join(names.select(F.col("parent").alias("grp")).distinct(), scaled, ["grp"], groups, "left").withColumn("parent", F.lit("all")), top)
    leaves = blended(small_join(names, scaled, ["grp"], groups, "left"), parents)
    judged = _distances(valued, written(_factored(leaves), "mcd-blend"), groups, ids, "left")
    distance = F.sqrt("d2")
    return judged.select(*ids, distance.alias("distance"), F.coalesce(distance > limit, F.lit(False)).alias("outlier"))


def quality(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and distance, a row for each row of docs.

    kept: the base rules pass and the text is no outlier of its language and source. Null languages and sources are groups like others. A null or empty
    text has no words and fails; a repeated row is judged like the first. An empty table gives no row. Other columns of docs are not read."""
    stats = written(base_statistics(docs, **options), "quality-stats")
    out = mcd_outliers(stats)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.col("outlier")).alias("kept"), "distance")
