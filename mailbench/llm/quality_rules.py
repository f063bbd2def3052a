"""Quality rules: base counts, and robust multivariate outliers by minimum covariance determinant.

DataFrame and SQL functions only.  Matrices stand in columns, one row per group, start and round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailbench.llm.common import WORD
from mailbench.session import stage

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words
MIN_GROUP = 200  # documents; smaller groups are judged by their language
MIN_POOL = 50  # documents; smaller languages are judged by all, and fewer in all judge no one
ROUNDS = 12
BINS = 32  # per doubling of the squared distance

# Chi-square with five degrees of freedom, quantiles at 0.5 and 0.975, and
# the inflation of a covariance cut at the latter.
HALF, TRIM, TRIM_FACTOR = 4.3515, 12.8325, 1.055
CUTOFF = 45.0  # squared robust distance beyond which a document is rejected

FEATURES = ("x0", "x1", "x2", "x3", "x4")
# Standard deviations that no group's estimate goes below, so that a statistic which is
# the same in nearly all documents of a group does not reject the others for any value.
# Where nearly all have no repeats, shares of repeated lines above 55 % and of repeated
# words above 40 % pass the cutoff alone: log1p(55) / 0.6 and log1p(40) / 0.55 are about sqrt(45).
FLOORS = (0.25, 0.05, 0.5, 0.6, 0.55)
_PAIRS = [(i, j) for i in range(5) for j in range(i + 1)]


def word_statistics(df: DataFrame, key: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of whole texts.

    Words of a text stand in one array; windows of three are compared by 64-bit hashes,
    sorted together with their places, so the work is n log n in the words of a text.  Null texts
    have no words.
    """
    words = df.select(
        F.col(key).alias("doc_id"), *carry, F.coalesce(F.col(text), F.lit("")).alias("_text"),
    ).withColumn("_words", F.regexp_extract_all("_text", F.lit(f"({WORD})"), 0))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))
    counted = words.select(
        "doc_id", *carry,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.expr("""CASE WHEN size(_words) < 4 THEN array(0L) ELSE transform(sequence(0, size(_words) - 3),
                  i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2))) END""").alias("_hash"),
    )
    apart = counted.withColumns({
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        # A power of two above the number of windows: hashes keep the bits above it.
        "_places": F.expr("CASE WHEN size(array_distinct(_hash)) < size(_hash) "
                          "THEN CAST(power(2, ceil(log2(size(_hash)))) AS BIGINT) END"),
    })
    by_hash = apart.withColumn("_order", F.expr(
        "CASE WHEN _places IS NOT NULL THEN transform(sort_array(transform(_hash, "
        "(x, i) -> (x & (0 - _places)) | i)), x -> CAST(x & (_places - 1) AS INT)) END"))
    twice = by_hash.withColumn("_twice", F.expr(
        "sort_array(filter(_order, (x, j) -> coalesce(get(_hash, x) = get(_hash, get(_order, j + 1)), false) "
        "OR coalesce(get(_hash, x) = get(_hash, get(_order, j - 1)), false)))"))
    return twice.select(
        "doc_id", *carry, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        F.expr("coalesce(aggregate(transform(_twice, (x, j) -> least(3, coalesce(get(_twice, j + 1), x + 3) - x)), "
               "0L, (a, x) -> a + x), 0L)").alias("n_repeat_words"))


def features() -> list[Column]:
    """The transformed statistics: length, word length, and shares of symbols, repeated lines and words."""
    words = F.col("n_words")
    share = [F.log1p(100.0 * F.col(a) / F.greatest(F.col(b), F.lit(1))) for a, b in
             (("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"))]
    columns = [F.log(words + 1.0), F.log(F.col("word_chars") / F.greatest(words, F.lit(1)) + 1.0), *share]
    return [c.alias(name) for c, name in zip(columns, FEATURES, strict=True)]


def cholesky(stats: DataFrame) -> DataFrame:
    """Add the factor ``l_i_j`` of the covariance ``c_i_j`` with the floors on its diagonal, and ``logdet``."""
    for i, j in _PAIRS:
        rest = F.col(f"c_{i}_{j}") + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            rest -= F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        value = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}")
        stats = stats.withColumn(f"l_{i}_{j}", value)
    return stats.withColumn("logdet", sum(2 * F.log(F.col(f"l_{i}_{i}")) for i in range(5)))


def with_distance(rows: DataFrame, name: str = "d2") -> DataFrame:
    """Squared Mahalanobis distance by forward substitution."""
    for i in range(5):
        z = F.col(f"x{i}") - F.col(f"m_{i}")
        for k in range(i):
            z -= F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        rows = rows.withColumn(f"z_{i}", z / F.col(f"l_{i}_{i}"))
    return rows.withColumn(name, sum(F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(5))).drop(*(f"z_{i}" for i in range(5)))


def _sums(dx: list[Column], weight: Column | None = None) -> list[Column]:
    w = F.lit(1.0) if weight is None else weight
    return [F.sum(w).alias("n"), *(F.sum(w * d).alias(f"s_{i}") for i, d in enumerate(dx)),
            *(F.sum(w * dx[i] * dx[j]).alias(f"s_{i}_{j}") for i, j in _PAIRS)]


def _moments(sums: DataFrame, factor: float = 1.0) -> list[Column]:
    """Mean and covariance from sums of deviations from ``o_i``."""
    mean = [F.col(f"s_{i}") / F.col("n") for i in range(5)]
    return [*((F.col(f"o_{i}") + mean[i]).alias(f"m_{i}") for i in range(5)),
            *((factor * (F.col(f"s_{i}_{j}") / F.col("n") - mean[i] * mean[j])).alias(f"c_{i}_{j}") for i, j in _PAIRS)]


BROADCAST_ROWS = 20_000  # of at most 50 numbers: 8 MB
SALTS = 64


def with_statistics(rows: DataFrame, stats: DataFrame, how: str = "inner", keys: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Rows with what a written table says of their group.  They stay where they are, or are dealt by salt and group: never by the group alone.

    The table is sent to all tasks if its rows, counted here, are few enough; else each row of it meets 64 parts of its group.
    """
    if stats.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(stats), [*keys], how)
    salted = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    parts = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(parts, [*keys, "_salt"], how).drop("_salt")


_STATS = [*(f"m_{i}" for i in range(5)), *(f"l_{i}_{j}" for i, j in _PAIRS)]


def first_estimates(vectors: DataFrame) -> DataFrame:
    """Three starts per group: robust scales alone, signs about the median, and plain moments."""
    middle = vectors.groupBy("grp").agg(
        F.count("*").alias("size"), *(F.percentile_approx(f"x{i}", 0.5, 10000).alias(f"o_{i}") for i in range(5)))
    middle = stage(middle, "mcd")  # a row per group: its size is known to the joins, and no group is gathered for it
    near = with_statistics(vectors, middle)
    scale = near.groupBy("grp", "size", *(f"o_{i}" for i in range(5))).agg(
        *(F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"o_{i}")), 0.5, 10000).alias(f"q_{i}") for i in range(5)))
    scale = scale.select("*", *((1.4826 * F.col(f"q_{i}") + FLOORS[i]).alias(f"w_{i}") for i in range(5)))
    scale = stage(scale, "mcd")
    about = with_statistics(vectors, scale)
    dx = [F.col(f"x{i}") - F.col(f"o_{i}") for i in range(5)]
    length = reduce(lambda a, b: a + b, ((d / F.col(f"w_{i}")) ** 2 for i, d in enumerate(dx)))
    keys = ["grp", "size", *(f"o_{i}" for i in range(5)), *(f"w_{i}" for i in range(5))]
    plain = about.groupBy(*keys).agg(*_sums(dx)).select("grp", "size", F.lit(2).alias("start"), *_moments(about))
    signs = about.groupBy(*keys).agg(*_sums(dx, 1.0 / F.greatest(length, F.lit(1e-6)))).select(
        "grp", "size", F.lit(1).alias("start"), *(F.col(f"o_{i}").alias(f"m_{i}") for i in range(5)),
        *((F.col(f"s_{i}_{j}") / F.col("n")).alias(f"c_{i}_{j}") for i, j in _PAIRS))
    alone = scale.select("grp", "size", F.lit(0).alias("start"), *(F.col(f"o_{i}").alias(f"m_{i}") for i in range(5)),
                         *((F.col(f"w_{i}") ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in _PAIRS))
    return cholesky(alone.unionByName(signs).unionByName(plain)).select("grp", "size", "start", *_STATS, "logdet")


def concentrate(vectors: DataFrame, stats: DataFrame) -> DataFrame:
    """One step for every group and start: moments of the half nearest by the estimates so far.

    Distances are counted in bins of about two percent, and whole bins are taken up to the one
    with the document of rank h, so that equal distances stay together and any order of rows gives
    the same half.  Only sums per bin are shuffled.
    """
    near = with_distance(with_statistics(vectors, stats.select("grp", "size", "start", *_STATS)))
    bin_ = F.floor(BINS * F.log2(F.greatest(F.col("d2"), F.lit(1e-9)))).cast("int")
    dx = [F.col(f"x{i}") - F.col(f"m_{i}") for i in range(5)]
    keys = ["grp", "size", "start", *(F.col(f"m_{i}").alias(f"o_{i}") for i in range(5))]
    binned = near.groupBy(*keys, bin_.alias("bin")).agg(*_sums(dx))
    upto = Window.partitionBy("grp", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    half = F.floor((F.col("size") + len(FEATURES) + 1) / 2)
    taken = binned.withColumn("upto", F.sum("n").over(upto)).where(F.col("upto") - F.col("n") < half)
    names = ["n", *(f"s_{i}" for i in range(5)), *(f"s_{i}_{j}" for i, j in _PAIRS)]
    sums = taken.groupBy("grp", "size", "start", *(f"o_{i}" for i in range(5))).agg(
        *(F.sum(x).alias(x) for x in names), F.pow(F.lit(2.0), (F.max("bin") + 1.0) / BINS).alias("edge"))
    return cholesky(sums.select("grp", "size", "start", "edge", *_moments(sums))).select(
        "grp", "size", "start", *_STATS, "logdet", "edge")


def robust_estimates(vectors: DataFrame) -> DataFrame:
    """``grp`` with mean and covariance factor: concentration from all starts, least determinant, reweighted.

    All groups and starts move in the same jobs; every round is a written table of one row per
    group and start, and the driver sees whether any determinant still changed.
    """
    stats, before = stage(first_estimates(vectors), "mcd"), None
    for _ in range(ROUNDS):
        after = stage(concentrate(vectors, stats), "mcd")
        old = stats.select("grp", "start", F.col("logdet").alias("old"))
        moved = after.join(old, ["grp", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("old")))).first()[0]
        stats = after
        if moved is None or moved < 1e-9 or before == moved:
            break
        before = moved
    best = stats.groupBy("grp").agg(F.min_by(F.struct(*_STATS, "edge"), F.struct("logdet", "start")).alias("b"))
    best = stage(best.select("grp", *(F.col(f"b.{x}").alias(x) for x in _STATS), (F.col("b.edge") / HALF).alias("scale")), "mcd")
    near = with_distance(with_statistics(vectors, best)).where(F.col("d2") <= TRIM * F.col("scale"))
    dx = [F.col(f"x{i}") - F.col(f"m_{i}") for i in range(5)]
    sums = near.groupBy("grp", *(F.col(f"m_{i}").alias(f"o_{i}") for i in range(5))).agg(*_sums(dx))
    return cholesky(sums.select("grp", *_moments(sums, TRIM_FACTOR))).select("grp", *_STATS)


def _name(*columns: str) -> Column:
    """Group name in which null differs from any value."""
    return F.concat_ws("\x01", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns))


def judging_groups(vectors: DataFrame) -> DataFrame:
    """``own, pool, grp, within``: by which group the rows of a language and source are judged, and which they count in.

    A pool holds all documents of its language that pass the base rules, those of large groups too,
    so ``within`` names up to three groups.  Pools that judge no row hold none.
    """
    sizes = stage(vectors.groupBy("own", "pool").agg(F.count_if(~F.col("base_failed")).alias("n")), "quality-groups")
    pools = sizes.groupBy("pool").agg(F.sum("n").alias("pool_n"), F.min("n").alias("least"))
    total, fewest = pools.agg(F.sum("pool_n"), F.min("pool_n")).first()
    everyone = F.lit("all") if total and total >= MIN_POOL else F.lit(None).cast("string")
    own, pool = (F.concat(F.lit(f"{c}\x01"), F.col(c)) for c in ("own", "pool"))
    large, enough = F.col("n") >= MIN_GROUP, F.col("pool_n") >= MIN_POOL
    counted = [F.when(large, own), F.when(enough & (F.col("least") < MIN_GROUP), pool),
               everyone if total and fewest < MIN_POOL else F.lit(None).cast("string")]
    return stage(sizes.join(pools, "pool").select(
        "own", "pool", F.when(large, own).when(enough, pool).otherwise(everyone).alias("grp"),
        F.array_compact(F.array(*counted)).alias("within")), "quality-groups")


def quality_verdicts(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
                     cutoff: float = CUTOFF) -> DataFrame:
    """One row per row of ``df``: counts, ``base_failed``, ``distance`` and ``kept``.

    Base rules: fewer than 50 words, or over half of the words in repeated windows of three.  The
    others are compared with the robust centre and spread of their language and source; where that
    has fewer than 200 such documents, of all those of their language, whatever their source; where
    the language has fewer than 50, of all.  Fewer than 50 in all judge no one (``distance`` null,
    kept).  Null languages and sources are groups of their own, null texts fail the base rules, null
    keys and repeated rows keep their rows.
    """
    plain = df.select(F.col(key).alias("_key"), F.col(text).alias("_text_in"), F.col(lang).alias("_lang"), F.col(source).alias("_source"))
    counts = word_statistics(plain, "_key", "_text_in", ("_lang", "_source"))
    counts = stage(counts.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                                     | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))), "quality")
    vectors = counts.select("*", *features(), _name("_lang", "_source").alias("own"), _name("_lang").alias("pool"))
    groups = judging_groups(vectors)
    grouped = stage(with_statistics(vectors, groups, "left", ("own", "pool")).drop("own", "pool"), "quality-vectors")
    judged = grouped.where(~F.col("base_failed")).select(F.explode("within").alias("grp"), *FEATURES)
    estimates = stage(robust_estimates(judged), "mcd")
    rows = with_distance(with_statistics(grouped, estimates, "left"), "distance")
    return rows.select(
        F.col("doc_id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"), "distance")
