"""Quality rules: base counts of each text, and robust multivariate outliers per language and source.

The base rules look at one text. The method compares a text with its peers. Every text that passes the base rules has a vector of
four transformed statistics that vary from text to text, whatever the corpus: the log of the mean word length, the share of
punctuation and symbols, the share of distinct words within stretches of 50 words (arcsine of the root of either), and the log of
the share of distinct words in the whole text. The last depends on a text's length, so all four are taken given length: as
residuals from a polynomial in the log of the number of words. Length by itself is no fault.

A minimum-covariance-determinant (MCD) estimate of location, slopes and covariance (with regressors: the multivariate least
trimmed squares of Agullo, Croux and Van Aelst, 2008) is found for each (lang, source), and a text is rejected when the squared
Mahalanobis distance of its residuals exceeds a chi-square quantile.

How the estimate is found over any number of rows:

* Two starts (median and MAD; all rows) are refined by concentration steps, each as long as its determinant falls by TOLERANCE. Each step is one
  aggregation with map-side combine: rows are counted and their moments summed by cell and by a logarithmic bin of the distance, so
  a cell yields at most BINS rows however many texts it has, and the nearest bins that hold half of the cell's rows give the next
  estimate. The half is rounded up to a whole bin. No row is sampled or left out.
* The estimate with the smallest determinant wins, then one reweighting step over the rows within the REWEIGHT quantile.
* Cells of any size are handled alike: to the moments of a cell come those of SHRINK more rows that are like the cell's language, to
  a language's those of SHRINK rows like the whole table. A large cell speaks for itself, a cell of one row for its language.
* What a text's length leaves to chance is added to the covariance when the text is judged: the sampling variance of each of its
  statistics. GUARD only keeps a covariance regular where all texts are alike; it is a hundredth of what prose shows or less.

Nulls: a null text has no words; null lang or source is a value of its own. Empty tables give empty results. Repeated rows each
count. quality() and quality_table() replace input columns that have the names of the columns they add; kept_rows() adds none, and
hands every input column on as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from math import exp, factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import derived, fresh, join_small, materialize, scratch, shipped, without
from .textbytes import _SPACE, _SYMBOL, blocks, windows

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: what else the vector is made from: non-alphanumeric ASCII signs, distinct words of the text, and the sum of those of each stretch
MORE = ("n_punct", "n_distinct", "stretch_distinct")
STRETCH = 50
DIMS, TERMS = 4, 3  # statistics; intercept and powers of centred log length
MIDDLE_LENGTH = 6.0
SHRINK = 50.0
GUARD = 1e-3
TOLERANCE, MOST_STEPS = 0.05, 50
BINS_PER_OCTAVE = 8
BINS = (-160, 240)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: chi-square quantiles for DIMS degrees of freedom: 0.5, 0.975 and 0.9999
HALF, REWEIGHT, CUTOFF = 3.357, 11.143, 23.513


def _chi2(q: float, even: int) -> float:
    return 1 - exp(-q / 2) * sum((q / 2) ** i / factorial(i) for i in range(even // 2))


#: the covariance of the inner half, and of the rows within REWEIGHT, of a normal cloud falls short by these factors
HALF_SCALE, REWEIGHT_SCALE = (_chi2(q, DIMS) / _chi2(q, DIMS + 2) for q in (HALF, REWEIGHT))

_PUNCT = np.array([c < 128 and not chr(c).isalnum() and not _SPACE[c] for c in range(256)])


def _distinct(sorted_rows: np.ndarray) -> int:
    """Distinct values of each row, added up."""
    return int(sorted_rows.size - (sorted_rows[..., 1:] == sorted_rows[..., :-1]).sum())


def count_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and MORE for each text of an Arrow array."""
    out = {c: np.zeros(len(texts), np.int64) for c in (*COUNTS, *MORE)}
    for b in blocks(texts):
        rows = slice(b.first, b.first + b.n)
        hashes, bounds = b.words()
        out["n_words"][rows] = np.diff(bounds)
        out["word_chars"][rows] = b.code_points(~_SPACE[b.data])
        out["n_symbols"][rows] = b.per_text(_SYMBOL[b.data])
        out["n_punct"][rows] = b.per_text(_PUNCT[b.data])
        lines, has_word, line_bounds = b.lines()
        tri = windows(hashes, 3, 3)
        for t in range(b.n):
            lo, hi = bounds[t], bounds[t + 1]
            own = lines[line_bounds[t] : line_bounds[t + 1]][has_word[line_bounds[t] : line_bounds[t + 1]]]
            if len(own) > 1:
                out["n_dup_lines"][b.first + t] = len(own) - len(np.unique(own))
            words = hashes[lo:hi]
            whole = len(words) // STRETCH * STRETCH
            out["stretch_distinct"][b.first + t] = _distinct(np.sort(words[:whole].reshape(-1, STRETCH), axis=1))
            out["n_distinct"][b.first + t] = _distinct(np.sort(words))
            if hi - lo > 3:
                own = tri[lo : hi - 2]
                order = np.argsort(own)
                ranked = own[order]
                same = ranked[1:] == ranked[:-1]
                if same.any():
                    twice = np.zeros(len(own) + 2, bool)
                    hit = np.concatenate([order[1:][same], order[:-1][same]])
                    twice[hit] = twice[hit + 1] = twice[hit + 2] = True
                    out["n_repeat_words"][b.first + t] = int(twice.sum())
    return out


def with_counts(df: DataFrame, text: str = "text", into: str | None = None) -> DataFrame:
    """df with COUNTS and MORE added, as columns or as one struct column `into`."""
    return derived(df, text, [T.StructField(c, T.LongType()) for c in (*COUNTS, *MORE)], lambda: lambda texts: [pa.array(v) for v in count_texts(texts).values()], into)


Get = Callable[[str], Column]


def base_failed(get: Get = F.col) -> Column:
    return (get("n_words") < MIN_WORDS) | (get("n_repeat_words") * 100 > get("n_words") * MAX_REPEAT_PERCENT)


def vector(get: Get = F.col) -> tuple[list[Column], list[Column], list[Column]]:
    """(terms of length, statistics, their sampling variances). Word lengths spread by about half their mean, the arcsine of the root
    of a share of n has 1 / 4n, and the log of the number of distinct words the difference of two reciprocals."""
    least = lambda c: F.greatest(get(c), F.lit(1))
    n, chars = least("n_words"), least("word_chars")
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), a / b)))
    stretches = F.greatest(F.floor(get("n_words") / STRETCH) * STRETCH, F.lit(1))
    length = F.log(n) - MIDDLE_LENGTH
    x = [F.log(chars / n), share(get("n_punct"), chars), share(get("stretch_distinct"), stretches), F.log(least("n_distinct") / n)]
    return [length, length * length], x, [0.25 / n, 0.25 / chars, 0.25 / stretches, 1 / least("n_distinct") - 1 / n]


V = ["z1", "z2", *(f"x{j}" for j in range(DIMS))]
UPPER = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
#: what an estimate consists of: intercepts and slopes of each statistic, and the inverse covariance
MODEL = [f"{t}{j}" for t in "abc" for j in range(DIMS)] + [f"p{i}{j}" for i, j in UPPER]
#: the moments it is made from: averages of the products of 1 and V
MOMENTS = [(i, j) for i in range(len(V) + 1) for j in range(i, len(V) + 1)]


def residuals(z: Sequence[Column], x: Sequence[Column], model: Get) -> list[Column]:
    return [x[j] - model(f"a{j}") - model(f"b{j}") * z[0] - model(f"c{j}") * z[1] for j in range(DIMS)]


def distance(z: Sequence[Column], x: Sequence[Column], model: Get) -> Column:
    """Squared Mahalanobis distance of the residuals."""
    d = residuals(z, x, model)
    return reduce(lambda a, b: a + b, [model(f"p{i}{j}") * d[i] * d[j] * (1.0 if i == j else 2.0) for i, j in UPPER])


def _let(value: Column, body: Get) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def noisy_distance(z: Sequence[Column], x: Sequence[Column], noise: Sequence[Column], model: Get) -> Column:
    """As distance(), a row's sampling variances added to the covariance.

    A variance v added to coordinate j takes v e_j^2 / (1 + v p_jj) off the squared distance, where e is the inverse covariance times
    the residuals; the rest of e and of the inverse follow by the same rank-one step (Sherman and Morrison), coordinate by coordinate.
    """
    p = lambda s, i, j: s[f"p{min(i, j)}{max(i, j)}"]
    put = lambda cols: F.struct(*[c.alias(k) for k, c in cols.items()])
    state = put({f"e{j}": r for j, r in enumerate(residuals(z, x, model))} | {f"v{j}": v for j, v in enumerate(noise)} | {f"p{i}{j}": model(f"p{i}{j}") for i, j in UPPER})

    def begin(s: Column) -> Column:
        whole = reduce(lambda a, b: a + b, [p(s, i, j) * s[f"e{i}"] * s[f"e{j}"] * (1.0 if i == j else 2.0) for i, j in UPPER])
        turned = {f"e{i}": reduce(lambda a, b: a + b, [p(s, i, j) * s[f"e{j}"] for j in range(DIMS)]) for i in range(DIMS)}
        return put({"d": whole} | turned | {f"v{j}": s[f"v{j}"] for j in range(DIMS)} | {f"p{i}{j}": p(s, i, j) for i, j in UPPER})

    def added(j: int) -> Callable[[Column], Column]:
        rest = range(j + 1, DIMS)

        def step(s: Column) -> Column:
            k = s[f"v{j}"] / (1 + s[f"v{j}"] * p(s, j, j))
            told = {"d": s["d"] - k * s[f"e{j}"] * s[f"e{j}"]} | {f"e{i}": s[f"e{i}"] - k * p(s, i, j) * s[f"e{j}"] for i in rest} | {f"v{i}": s[f"v{i}"] for i in rest}
            return put(told | {f"p{i}{n}": p(s, i, n) - k * p(s, i, j) * p(s, j, n) for i in rest for n in rest if i <= n})

        return step

    state = _let(state, begin)
    for j in range(DIMS):
        state = _let(state, added(j))
    return state["d"]


def estimates(average: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(values of MODEL, log determinant) for each row of average moments."""
    full = np.empty((len(average), len(V) + 1, len(V) + 1))
    for k, (i, j) in enumerate(MOMENTS):
        full[:, i, j] = full[:, j, i] = average[:, k]
    zz, zx, xx = full[:, :TERMS, :TERMS], full[:, :TERMS, TERMS:], full[:, TERMS:, TERMS:]
    coef = np.linalg.solve(zz + np.diag([0] + [1e-8] * (TERMS - 1)), zx)  # the ridge is for tables whose texts are all as long
    back = coef.transpose(0, 2, 1)
    scatter = (xx - back @ zx - zx.transpose(0, 2, 1) @ coef + back @ zz @ coef) * scale
    eigen = np.maximum(np.linalg.eigvalsh(scatter), 1e-12)
    inverse = np.linalg.inv(scatter + GUARD**2 * np.eye(DIMS))
    return np.concatenate([coef.reshape(len(average), -1), np.stack([inverse[:, i, j] for i, j in UPPER], axis=1)], axis=1), np.log(eigen).sum(axis=1)


def tag(*of: str) -> Column:
    """The name of a cell: (), (lang) or (lang, source)."""
    return F.to_json(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0000")) for c in of])) if of else F.lit("[]")


_MODEL_KIND = ", ".join(f"{c}: double" for c in MODEL)
_MODEL_SCHEMA = f"cell string, start int, logdet double, model struct<{_MODEL_KIND}>"


def _moments() -> list[Column]:
    v = [F.lit(1.0), *map(F.col, V)]
    return [F.sum(v[i] * v[j]).alias(f"s{k}") for k, (i, j) in enumerate(MOMENTS)]


def _models(sums: DataFrame, every: DataFrame, tree: DataFrame, scale: float) -> DataFrame:
    """Estimates from (cell, start, s: sums of moments), each cell drawn towards the cell above it, and that towards the one above; every has the sums of those."""
    up = lambda k: every.select(F.col("cell").alias(f"up{k}"), "start", F.col("s").alias(f"s{k}"))
    both = sums.join(tree, "cell").join(up(1), ["up1", "start"], "left").join(up(2), ["up2", "start"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            average = None
            for c in ("s2", "s1", "s"):  # from the whole table down; column 0 is the count
                missing = b[c].isna().to_numpy()
                own = np.stack([np.zeros(len(MOMENTS)) if m else np.asarray(s) for s, m in zip(b[c], missing, strict=True)])
                prior = np.zeros_like(own) if average is None else average
                weight = np.where(prior[:, :1] > 0, SHRINK, 0.0)
                total = own + weight * prior
                average = np.where(total[:, :1] > 0, total / np.maximum(total[:, :1], 1e-300), prior)
            values, logdet = estimates(average, scale)
            yield pd.DataFrame({"cell": b["cell"], "start": b["start"], "logdet": logdet, "model": [dict(zip(MODEL, map(float, v), strict=True)) for v in values]})

    return materialize(shipped(both.select("cell", "start", "s", "s1", "s2")).mapInPandas(run, _MODEL_SCHEMA), "models")


def fit(vectors: DataFrame) -> DataFrame:
    """(cell, model) for each (lang, source) of a table of lang, source and V. Cells are named by tag()."""
    with scratch(vectors.sparkSession):
        return materialize(_fit(vectors), "models", keep=True)


def _fit(vectors: DataFrame) -> DataFrame:
    rows = materialize(vectors.select(tag("lang", "source").alias("own"), tag("lang").alias("lang"), *V), "vectors")
    names = rows.select("own", "lang").distinct()
    tree = names.select(F.col("own").alias("cell"), F.col("lang").alias("up1"), F.lit("[]").alias("up2")).unionByName(names.select(F.col("lang").alias("cell"), F.lit("[]").alias("up1"), F.lit(None).cast("string").alias("up2")).distinct())
    tree = materialize(tree.unionByName(names.limit(1).select(F.lit("[]").alias("cell"), F.lit(None).cast("string").alias("up1"), F.lit(None).cast("string").alias("up2"))), "tree")
    every = rows.select(F.explode(F.array("own", "lang", F.lit("[]"))).alias("cell"), *V)  # a row speaks for its cell, its language and all
    z, x = [F.col(c) for c in V[: TERMS - 1]], [F.col(c) for c in V[TERMS - 1 :]]

    # start 0: medians and MADs, which are sketched and combined before they are shuffled; start 1: all rows
    middle = materialize(every.groupBy("cell").agg(F.array(*[F.percentile_approx(c, F.lit(0.5), F.lit(2000)) for c in x]).alias("m")), "middle")
    away = join_small(every, middle, "cell").groupBy("cell").agg(F.first("m").alias("m"), F.array(*[F.percentile_approx(F.abs(c - F.col("m")[j]), F.lit(0.5), F.lit(2000)) for j, c in enumerate(x)]).alias("d"))
    model = {f"a{j}": F.col("m")[j] for j in range(DIMS)} | {f"p{j}{j}": 1 / (F.pow(1.4826 * F.col("d")[j], F.lit(2.0)) + GUARD**2) for j in range(DIMS)}
    first = away.select("cell", F.lit(0).alias("start"), F.lit(float("inf")).alias("logdet"), F.struct(*[model.get(c, F.lit(0.0)).alias(c) for c in MODEL]).alias("model"))
    sums = materialize(every.groupBy("cell").agg(*_moments()).select("cell", F.lit(1).alias("start"), F.array(*[f"s{k}" for k in range(len(MOMENTS))]).alias("s")), "sums")
    models = materialize(first.unionByName(_models(sums, sums, tree, 1.0).withColumn("logdet", F.lit(float("inf")))), "models")

    def inner(models: DataFrame) -> DataFrame:
        """(cell, start, s) of the nearest half of each cell's rows."""
        d = F.floor(F.log2(F.greatest(distance(z, x, lambda c: F.col(f"model.{c}")), F.lit(1e-6))) * BINS_PER_OCTAVE)
        binned = join_small(every, models, "cell").groupBy("cell", "start", F.least(F.greatest(d, F.lit(BINS[0])), F.lit(BINS[1])).alias("bin")).agg(*_moments())
        by = Window.partitionBy("cell", "start")
        nearer = F.coalesce(F.sum("s0").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        half = binned.withColumn("nearer", nearer).withColumn("all", F.sum("s0").over(by)).where(F.col("nearer") < F.floor((F.col("all") + DIMS + TERMS) / 2))
        sums = half.groupBy("cell", "start").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(len(MOMENTS))])
        return sums.select("cell", "start", F.array(*[f"s{k}" for k in range(len(MOMENTS))]).alias("s"))

    # a cell's start takes steps as long as its determinant falls; the cells below go on with the last sums of those above
    steps, sums = [], None
    for _ in range(MOST_STEPS):
        done = [sums.join(models.select("cell", "start"), ["cell", "start"], "left_anti")] if sums is not None else []
        sums = materialize(reduce(DataFrame.unionByName, [inner(models), *done]), "sums")
        steps.append(_models(sums.join(models.select("cell", "start"), ["cell", "start"], "left_semi"), sums, tree, HALF_SCALE))
        was = models.select("cell", "start", F.col("logdet").alias("was"))
        models = materialize(steps[-1].join(was, ["cell", "start"]).where(F.col("logdet") < F.col("was") - TOLERANCE).drop("was"), "falling")
        if not models.limit(1).count():
            break
    best = reduce(DataFrame.unionByName, steps).groupBy("cell").agg(F.min_by(F.struct("model"), F.struct("logdet", "start")).alias("b")).select("cell", "b.model")
    near = join_small(every, materialize(best, "best"), "cell").where(distance(z, x, lambda c: F.col(f"model.{c}")) <= REWEIGHT).groupBy("cell").agg(*_moments())
    sums = materialize(near.select("cell", F.lit(0).alias("start"), F.array(*[f"s{k}" for k in range(len(MOMENTS))]).alias("s")), "sums")
    last = _models(sums, sums, tree, REWEIGHT_SCALE)
    # a cell none of whose rows are near its estimate has no moments of its own: it takes its best estimate as it is
    return best.join(last.select("cell", F.col("model").alias("after")), "cell", "left").select("cell", F.coalesce("after", "model").alias("model"))


def fit_counted(counted: DataFrame, get: Get = F.col) -> DataFrame:
    z, x, _ = vector(get)
    return fit(counted.where(~base_failed(get)).select("lang", "source", *[c.alias(n) for c, n in zip([*z, *x], V, strict=True)]))


def judged(df: DataFrame, models: DataFrame, get: Get, out: str) -> DataFrame:
    """df (lang, source, and counts to be had by get) with the struct column `out`: base_failed, distance (null: no peers), kept."""
    cell, model, d = (fresh([*df.columns, out], n) for n in ("cell_of", "model_of", "distance_of"))
    both = join_small(df.withColumn(cell, tag("lang", "source")), models.select(F.col("cell").alias(cell), F.col("model").alias(model)), cell, "left")
    z, x, noise = vector(get)
    far = noisy_distance(z, x, noise, lambda c: F.col(f"`{model}`.`{c}`"))
    both = both.withColumn(d, F.when(F.col(f"`{model}`").isNotNull(), far))
    far = F.coalesce(F.col(f"`{d}`") > CUTOFF, F.lit(False))
    verdict = F.struct(base_failed(get).alias("base_failed"), F.col(f"`{d}`").alias("distance"), (~base_failed(get) & ~far).alias("kept"))
    return both.select(*[F.col(f"`{c}`") for c in df.columns], verdict.alias(out))


ADDED = ("base_failed", "distance", "kept")


def _in_place(df: DataFrame, text: str) -> tuple[DataFrame, str, str]:
    """df with two struct columns, counts and verdict, and their names.

    Two passes over the texts: the first gathers the thin statistic table that the estimates come from, the second judges each row
    where it lies, so that no text is ever shuffled.
    """
    with scratch(df.sparkSession):
        thin = materialize(with_counts(df.select(text, "lang", "source"), text).drop(text), "counts")
        models = materialize(fit_counted(thin), "models", keep=True)
    counts = fresh(df.columns, "counts_of")
    verdict = fresh([*df.columns, counts], "verdict_of")
    done = judged(with_counts(df, text, counts), models, lambda c: F.col(f"`{counts}`.`{c}`"), verdict)
    return done, counts, verdict


def quality(df: DataFrame, text: str = "text") -> DataFrame:
    """df (text, lang, source and any more columns) with COUNTS, base_failed, distance and kept."""
    done, counts, verdict = _in_place(df, text)
    keep = without(df, *COUNTS, *ADDED).columns
    return done.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{counts}`.`{c}`") for c in COUNTS], *[F.col(f"`{verdict}`.`{c}`") for c in ADDED])


def kept_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df that are kept, with df's columns and no others."""
    done, _, verdict = _in_place(df, text)
    return done.where(F.col(f"`{verdict}`.kept")).select(*[F.col(f"`{c}`") for c in df.columns])


def quality_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, COUNTS, base_failed, distance and kept: one pass over the texts, then the thin statistic table is both fitted and judged."""
    thin = with_counts(df.select(F.col(key).alias("key"), text, "lang", "source"), text).drop(text)
    counted = materialize(thin, "counts")
    done = judged(counted, fit_counted(counted), F.col, "verdict_of")
    return done.select(F.col("key").alias(key), *COUNTS, *[F.col(f"verdict_of.{c}") for c in ADDED])
