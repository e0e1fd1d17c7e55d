"""Quality rules with robust multivariate outliers.

Each text gives five statistics by one pass over its bytes. Texts that fail the base rules (fewer than
``MIN_WORDS`` words, or more than ``MAX_REPEAT`` per cent of their words in repeated three-word windows) are
rejected at once. For the others the transformed statistics form a vector; per language and source the
minimum-covariance-determinant estimate finds the mean and covariance of the tightest ``SUBSET`` of vectors,
and a text whose squared Mahalanobis distance exceeds the chi-square quantile ``QUANTILE`` is rejected.

The estimate is fitted by concentration steps from several deterministic starts (``STARTS``): the subset, the half and the
whole of the vectors that are nearest to the medians by median absolute deviations. Each start takes steps until its
subset no longer changes (at most ``STEPS``), and the one whose covariance has the least determinant is taken. A step
measures all distances, and sums counts, vectors and products by group, start and distance class; the classes up
to the one that reaches the subset's size give the next estimate. So a step is one aggregate with map-side combining
whatever a group's size, and no group is ever gathered. Vectors lie on an integer grid (``GRID`` steps a unit), so
sums are exact and results don't depend on partitions. No statistic's variance counts as less than the square of its
``FLOOR``, since most clean texts have no symbols or repeats at all. Groups
of fewer than ``LEAST_GROUP`` texts use the estimate of their language, or else of all texts; those estimates are
fitted on every text of the language, or every text, that passes the base, whichever estimate judges it.

Null and blank texts have no words and fail the base. A null language or source is a group like another.
Rows with one id are judged one by one. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _kernel as K
from ._shared import ROW_KEY, Workspace, row_key

MIN_WORDS = 50
MAX_REPEAT = 50
SUBSET = 0.75
#: The share of the nearest vectors that each start takes first.
STARTS = (0.75, 0.5, 1.0)
STEPS = 20
LEAST_GROUP = 50
QUANTILE = 1 - 1e-5
GRID = 256
#: Classes of squared distance: 32 for each doubling.
CLASSES_PER_DOUBLING = 32
NAMES = ("words", "length", "symbols", "lines", "repeats")
#: The least standard deviations of the transformed statistics, in the order of NAMES.
FLOOR = (1.0, 0.5, 0.12, 0.35, 0.12)
P = len(NAMES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def statistics(raw: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text."""
    docs = len(at) - 1
    start, end, first = K.words(raw, at)
    total = lambda flag: np.diff(np.concatenate(([0], np.cumsum(flag)))[at])
    solid = ~K.IS_SPACE[raw]
    out = {"n_words": np.diff(first), "word_chars": total(solid & ((raw & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[raw])}
    doc_of_word = np.repeat(np.arange(docs), np.diff(first))

    breaks = np.flatnonzero(raw == 10)
    line_start = np.union1d(at[:-1], breaks + 1)
    line_start = line_start[line_start < len(raw)]
    line_end = np.append(line_start[1:], len(raw))
    line_end = line_end - ((line_end > line_start) & (raw[line_end - 1] == 10)) if len(line_start) else line_end
    worded = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[worded], line_end[worded]
    doc = np.searchsorted(at, line_start, "right") - 1
    key = K.mix(K.span_hash(raw, line_start, line_end) + doc.astype(np.uint64) * K.BASE)
    _, kinds = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(doc, minlength=docs) - np.bincount(doc[kinds], minlength=docs)

    word = K.span_hash(raw, start, end)
    n = max(0, len(word) - 2)
    within = doc_of_word[:n] == doc_of_word[2:] if n else np.zeros(0, bool)
    window = K.mix(word[:n] + word[1 : n + 1] * np.uint64(0x9FB21C651E98DF25) + word[2 : n + 2] * np.uint64(0xD6E8FEB86659FD93) + doc_of_word[:n].astype(np.uint64) * K.BASE)
    where = np.flatnonzero(within)
    _, inverse, count = np.unique(window[where], return_inverse=True, return_counts=True)
    again = where[count[inverse] > 1]
    covered = np.zeros(len(word) + 1, bool)
    for j in range(3):
        covered[again + j] = True
    out["n_repeat_words"] = np.bincount(doc_of_word[covered[: len(word)]], minlength=docs)
    return out


def _measure(batches):
    order = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for batch, raw, at in K.steps(batches):
        got = statistics(raw, at)
        rest = [batch.column(batch.schema.get_field_index(c)) for c in ("rk", "doc_id", "lang", "source")]
        yield pa.RecordBatch.from_arrays([*rest, *(pa.array(got[c], pa.int64()) for c in order)], ["rk", "doc_id", "lang", "source", *order])


MEASURED = f"rk {ROW_KEY}, doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words")


def vector() -> list[Column]:
    """The transformed statistics on the integer grid."""
    n = F.greatest("n_words", F.lit(1))
    real = [F.log1p("n_words"), F.col("word_chars") / n, F.sqrt(F.col("n_symbols") / n), F.log1p("n_dup_lines"), F.sqrt(F.col("n_repeat_words") / n)]
    return [F.round(x * GRID).cast("long").alias(f"x{i}") for i, x in enumerate(real)]


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its power series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi_square_quantile(p: float, freedom: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(freedom / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def consistency(share: float = SUBSET, p: int = P) -> float:
    """What a covariance of the nearest ``share`` of normal vectors is multiplied with."""
    return share / gamma_p(p / 2 + 1, chi_square_quantile(share, p) / 2)


def estimate(count: float, total: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, inverse covariance and logarithm of its determinant, in units of the grid, from exact sums of a subset."""
    mean = total / count
    cov = (product / count - np.outer(mean, mean)) * consistency()
    diagonal = np.diag_indices(P)
    cov[diagonal] = np.maximum(cov[diagonal], (np.array(FLOOR) * GRID) ** 2) + 1.0  # vectors are known to a step of the grid
    return mean, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def _states(batches):
    """The next estimate of each group and start from the sums of its subset."""
    for batch in batches:
        groups, starts, count = batch.column(0), batch.column(1), batch.column(2)
        n = count.to_numpy()
        sums = np.array([c.to_pylist() for c in batch.columns[3:]], float).reshape(P + len(PAIRS), -1)
        means, inverses, sizes = [], [], []
        for g in range(batch.num_rows):
            product = np.zeros((P, P))
            for k, (i, j) in enumerate(PAIRS):
                product[i, j] = product[j, i] = sums[P + k, g]
            mean, inverse, size = estimate(n[g], sums[:P, g], product)
            means.append(mean.tolist())
            inverses.append([inverse[i, j] * (1 if i == j else 2) for i, j in PAIRS])
            sizes.append(size)
        columns = [groups, starts, count, pa.array(means, pa.list_(pa.float64())), pa.array(inverses, pa.list_(pa.float64())), pa.array(sizes, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["grp", "start", "n", "mean", "inverse", "volume"])


STATE = "grp int, start int, n long, mean array<double>, inverse array<double>, volume double"


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from ``mean`` under ``inverse``."""
    d = [F.col(f"x{i}") - F.col("mean")[i] for i in range(P)]
    out = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        out = out + F.col("inverse")[k] * d[i] * d[j]
    return out


def grouped(stats: DataFrame, space: Workspace) -> DataFrame:
    """Adds ``grp``, the group whose estimate judges the row, ``fits``, the groups whose estimates it helps to fit, and the vector; only rows that pass the base."""
    fine, coarse = F.concat(F.lit("f"), F.to_json(F.struct("lang", "source"))), F.concat(F.lit("c"), F.to_json(F.struct("lang")))
    rows = stats.where(~base_failed()).withColumns({"fine": fine, "coarse": coarse})
    by_coarse = Window.partitionBy("coarse")  # one row for each group
    size = rows.groupBy("coarse", "fine").agg(F.count("*").alias("n"))
    size = space.save(size.withColumns({"all_n": F.sum("n").over(by_coarse), "least_n": F.min("n").over(by_coarse)}), "sizes")
    least = F.lit(LEAST_GROUP)
    chosen = F.when(F.col("n") >= least, F.col("fine")).when(F.col("all_n") >= least, F.col("coarse")).otherwise(F.lit("*"))
    # A row takes part in each estimate of its own that any row is judged by.
    own = F.when(F.col("n") >= least, F.col("fine"))
    language = F.when((F.col("least_n") < least) & (F.col("all_n") >= least), F.col("coarse"))
    size = size.crossJoin(F.broadcast(size.agg(F.min("all_n").alias("least_all"))))  # one row
    everything = F.when(F.col("least_all") < least, F.lit("*"))
    size = space.save(size.select("fine", chosen.alias("grp"), F.array_compact(F.array(own, language, everything)).alias("fits")), "groups")
    return space.save(rows.join(size, "fine").select(*stats.columns, "grp", "fits", *vector()), "vectors")


def fit(vectors: DataFrame, space: Workspace) -> DataFrame:
    """Rows ``(grp, mean, inverse)``: the estimate of each group, from all rows that it stands for.

    Inside, groups are numbered. A join with a few broadcast rows takes a page of tens of MB in each executor if its key is
    a string, and keeps it while the broadcast lives; for integers it takes what the rows need. Each step has such joins.
    """
    vectors = vectors.select(F.explode("fits").alias("name"), *(f"x{i}" for i in range(P)))
    number = F.row_number().over(Window.orderBy("name"))  # one row for each group
    numbers = space.save(vectors.select("name").distinct().select("name", number.cast("int").alias("grp")), "numbers")
    vectors = space.save(vectors.join(numbers, "name").select("grp", *(f"x{i}" for i in range(P))), "numbered")
    middle = vectors.groupBy("grp").agg(*(F.percentile(f"x{i}", F.lit(0.5)).alias(f"m{i}") for i in range(P)))  # counts by grid value
    middle = space.save(middle, "medians")
    spread = vectors.join(middle, "grp").groupBy("grp").agg(*(F.first(f"m{i}").alias(f"m{i}") for i in range(P)), *(F.percentile(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), F.lit(0.5)).alias(f"s{i}") for i in range(P)))
    precision = [1 / (F.greatest(F.pow(1.4826 * F.col(f"s{i}"), 2), F.lit((FLOOR[i] * GRID) ** 2)) + 1.0) if i == j else F.lit(0.0) for i, j in PAIRS]
    first = spread.select("grp", F.array(*(F.col(f"m{i}") for i in range(P))).alias("mean"), F.array(*precision).alias("inverse"))
    starts = F.posexplode(F.array(*(F.lit(x) for x in STARTS))).alias("start", "share")
    state = space.save(first.select("grp", starts, F.lit(0).cast("long").alias("n"), "mean", "inverse"), "state-0")
    sums = [F.sum(f"x{i}").alias(f"a{i}") for i in range(P)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"b{i}{j}") for i, j in PAIRS]
    names = [f"a{i}" for i in range(P)] + [f"b{i}{j}" for i, j in PAIRS]
    for turn in range(1, STEPS + 1):
        near = F.floor(F.log2(distance() + 1e-3) * CLASSES_PER_DOUBLING)
        classes = vectors.join(state, "grp").withColumn("near", near).groupBy("grp", "start", "share", "near").agg(F.count("*").alias("n"), *sums)
        by_start = Window.partitionBy("grp", "start")  # some hundreds of distance classes
        before = F.sum("n").over(by_start.orderBy("near").rowsBetween(Window.unboundedPreceding, -1))
        kept = classes.withColumns({"before": F.coalesce(before, F.lit(0)), "all": F.sum("n").over(by_start)}).where(F.col("before") < F.col("share") * F.col("all"))
        subset = kept.groupBy("grp", "start").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in names))
        was = state.select("grp", "start", F.col("n").alias("was_n"), F.col("mean").alias("was_mean"), F.col("inverse").alias("was_inverse"))
        state = space.save(subset.select("grp", "start", "n", *names).mapInArrow(_states, STATE), f"state-{turn}")
        if state.join(was, ["grp", "start"]).where("n <> was_n or mean <> was_mean or inverse <> was_inverse").isEmpty():
            break
        state = state.withColumn("share", F.lit(SUBSET))
    best = state.groupBy("grp").agg(F.min_by(F.struct("mean", "inverse"), F.struct("volume", "start")).alias("best"))
    return best.join(numbers, "grp").select(F.col("name").alias("grp"), "best.*")


def judged(docs: DataFrame, space: Workspace) -> DataFrame:
    """Statistics and verdicts: the columns of the report and ``rk``, one row for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    rows = rows.withColumn("rk", row_key())
    stats = space.save(rows.mapInArrow(_measure, MEASURED), "stats")
    vectors = grouped(stats, space)
    limit = chi_square_quantile(QUANTILE, P)
    shown = ["rk", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    passed = vectors.join(fit(vectors, space), "grp").select(*shown, F.lit(False).alias("base_failed"), (distance() <= limit).alias("kept"), F.sqrt(distance()).alias("distance"), "grp")
    failed = stats.where(base_failed()).select(*shown, F.lit(True).alias("base_failed"), F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("string").alias("grp"))
    return passed.union(failed)


def quality_report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: statistics, base_failed, kept, and the distance that decided."""
    return judged(docs, Workspace(docs.sparkSession, "quality")).drop("rk", "grp")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass; columns as they are."""
    gone = judged(docs, Workspace(docs.sparkSession, "quality")).where("not kept").select(F.col("rk").alias("__rk")).distinct()
    keyed = docs.withColumn("__key", row_key())
    return keyed.join(gone, F.col("__key") == F.col("__rk"), "left_anti").drop("__key")
