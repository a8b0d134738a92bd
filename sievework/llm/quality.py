"""Quality classifier: a sparse ensemble of rules.

Statistics of the texts are computed once over all rows.  Small decision trees are grown on a bounded sample of
labelled rows; every path from a root is a rule, a conjunction of comparisons; an L1-penalised logistic regression
gives most rules the weight 0; the rest become one Spark column expression.

Defined cases: null and empty texts have all statistics 0 and a score like any other; labels that are null or
neither 0 nor 1 are not used; without labelled rows every score is 0.5, with one class only it is that class's
smoothed share; a row counts as often as it is labelled; an empty table gives no rows; splits of equal gain go to the
later statistic, then the greater cut; statistics are taken over whole texts of any length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import hashing as H
from sievework.llm.repeats import MARK, keyed, mark_of
from sievework.llm.shared import hash_sample, staged, text_bytes, text_slices, without

STATS = ["n_bytes", "n_words", "word_bytes", "upper", "digit", "symbol", "bar", "beyond_ascii", "repeated", "distinct", "noisy_words", "shouted_words", "line_words", "repeated_lines"]
#: At most so many labelled rows are brought together for the fit, in the order of a hash of doc_id.
FIT_ROWS = 20_000
TREES, DEPTH, CUTS = 24, 3, 24
REJECT_BELOW = 0.7


def statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of STATS for each text."""
    n = len(bounds) - 1

    def share(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(of, 1)

    size = np.diff(bounds)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, beyond = (data >= 48) & (data <= 57), data >= 128
    symbol = (data > 32) & (data < 127) & ~upper & ~lower & ~digit & ~np.isin(data, [44, 46, 39, 34, 45])
    starts, ends, words = H.word_bounds(data, bounds)
    number = np.diff(words)
    prints, owner = H.word_prints(H.lower_ascii(data), starts, ends), H.row_of(words)

    def word_share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=n) / np.maximum(number, 1)

    again = np.zeros(len(prints), dtype=bool)
    if len(prints):
        again[1:] = (prints[1:] == prints[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((prints, owner))
    new = np.ones(len(prints), dtype=bool)
    if len(prints):
        p, o = prints[order], owner[order]
        new[1:] = (p[1:] != p[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(owner[order][new], minlength=n) / np.maximum(number, 1)
    noise = np.concatenate([[0], np.cumsum(symbol)])
    shout = np.concatenate([[0], np.cumsum(upper)])
    quiet = np.concatenate([[0], np.cumsum(lower)])
    noisy = noise[ends] - noise[starts] >= 2
    shouted = (shout[ends] - shout[starts] >= 2) & (quiet[ends] == quiet[starts])
    # lines: maximal runs of bytes other than a line feed
    feed = data == 10
    line_end = np.union1d(np.flatnonzero(feed), bounds[1:])
    line_start = np.concatenate([[0], line_end[:-1] + feed[np.minimum(line_end[:-1], max(len(data) - 1, 0))]]) if len(line_end) else line_end
    line_start = np.minimum(line_start, line_end)
    full = line_end > line_start
    line_start, line_end = line_start[full], line_end[full]
    line_owner = np.searchsorted(bounds, line_start, side="right") - 1
    lines = np.bincount(line_owner, minlength=n)
    line_print = H.fingerprints(H.prefix(H.byte_values()[data]), line_start, line_end)
    order = np.lexsort((line_print, line_owner))
    same = np.zeros(len(order), dtype=bool)
    if len(order):
        p, o = line_print[order], line_owner[order]
        same[1:] = (p[1:] == p[:-1]) & (o[1:] == o[:-1])
    repeated_lines = np.bincount(line_owner[order][same], minlength=n) / np.maximum(lines, 1)
    letters = share(upper | lower | beyond, np.ones(n))
    word_bytes = np.bincount(owner, weights=ends - starts, minlength=n) / np.maximum(number, 1)
    columns = [size, number, word_bytes, share(upper, np.ones(n)) / np.maximum(letters, 1), share(digit, size), share(symbol, size), share(data == 124, number), share(beyond, size), word_share(again), distinct, word_share(noisy), word_share(shouted), number / np.maximum(lines, 1), repeated_lines]
    return np.column_stack([np.asarray(c, dtype=np.float64) for c in columns])


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kinds = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), *((s, pa.float64()) for s in STATS)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = statistics(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *map(pa.array, found.T)], schema=kinds)

    return keyed(docs, id_col, text_col).mapInArrow(task, "doc_id long, mark binary, " + ", ".join(f"{s} double" for s in STATS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, bound), all of which hold


def tree_rules(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, trees: int, depth: int) -> list[Rule]:
    """The paths of trees grown on random rows with random statistics at each split."""
    rules: dict[Rule, None] = {}
    tried = max(2, int(np.sqrt(x.shape[1])) + 1)

    def grow(rows: np.ndarray, path: Rule) -> None:
        if path:
            rules[tuple(sorted(path))] = None
        share = y[rows].mean()
        if len(path) == depth or len(rows) < 20 or share in (0.0, 1.0):
            return
        best = (1e-9, 0, 0.0)
        for f in rng.choice(x.shape[1], tried, replace=False):
            v = x[rows, f]
            for cut in np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1])):
                right = v > cut
                k = int(right.sum())
                if min(k, len(rows) - k) < 5:
                    continue
                a, b = y[rows][right].mean(), y[rows][~right].mean()
                gain = share * (1 - share) - (k * a * (1 - a) + (len(rows) - k) * b * (1 - b)) / len(rows)
                best = max(best, (gain, int(f), float(cut)))
        if best[0] > 1e-9:
            right = x[rows, best[1]] > best[2]
            grow(rows[right], (*path, (best[1], True, best[2])))
            grow(rows[~right], (*path, (best[1], False, best[2])))

    for _ in range(trees):
        grow(rng.choice(len(y), min(len(y), 4000), replace=True), ())
    return list(rules)


def rule_matrix(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    return np.column_stack([np.logical_and.reduce([(x[:, f] > c) == above for f, above, c in r]) for r in rules]).astype(np.float64)


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = 0.002, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean logistic loss + penalty * |weights|, by accelerated proximal steps."""
    a = np.column_stack([np.ones(len(y)), r])
    step = 4.0 / max(np.linalg.norm(a, 2) ** 2 / len(y), 1e-9)
    w = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ z, -50, 50))) - y) / len(y)
        new = z - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z = new + (before - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and the rules of non-zero weight."""
    if not len(y):
        return 0.0, []
    if y.min() == y.max():
        return float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), []
    rules = tree_rules(x, y, np.random.default_rng(seed), TREES, DEPTH)
    if not rules:
        return float(np.log(y.mean() / (1 - y.mean()))), []
    intercept, weights = lasso_logistic(rule_matrix(x, rules), y)
    return intercept, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6]


def score_column(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The rules as one expression over the columns of STATS."""

    def holds(rule: Rule) -> Column:
        return reduce(and_, [(F.col(STATS[f]) > c) if above else (F.col(STATS[f]) <= c) for f, above, c in rule])

    total = reduce(add, [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in rules], F.lit(intercept))
    return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and mark (of id and text) of every row."""
    stats = staged(with_statistics(docs), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_label")).filter(F.col("_label").isin(0, 1) & ~held_out(F.col("doc_id")))
    drawn = hash_sample(known, fit_rows, known.count(), "doc_id", "_label")
    sample = stats.join(drawn, "doc_id").orderBy(F.xxhash64("doc_id"), *STATS, "_label").limit(fit_rows).select(*STATS, "_label").toArrow()
    x = np.column_stack([sample[s].to_numpy() for s in STATS])
    intercept, rules = fit_rules(x, sample["_label"].to_numpy().astype(np.float64))
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(intercept, rules).alias("score"), "mark").withColumn("predicted", (F.col("score") >= REJECT_BELOW).cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("mark")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (all columns) without those that the classifier rejects."""
    rejected = staged(quality_scores(docs, labels).filter("predicted = 0").select(F.col("mark").alias(MARK)).distinct(), "rejected")
    marked = docs.withColumn(MARK, mark_of(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return without(marked, rejected, MARK).select(*docs.columns)
