"""Operator 1, quality classifier: a sparse rule ensemble.

Spark computes statistics of whole texts. On a bounded sample of labelled rows (SAMPLE of them at most on average, chosen by a hash of
doc_id), shallow regression trees are boosted in numpy; every path from a root is a rule, a conjunction of thresholds on the statistics.
A logistic regression with an L1 penalty on the rules' indicators leaves few of them; those are compiled into one Spark column expression,
which scores all documents. Rows whose crc32(doc_id as text) mod 5 is 0 are held out from learning. Labels, lang, source and doc_id are never
inputs of a score.

Defined cases: null texts count as empty, and have statistics and a score; labels that are null or not 0 or 1 aren't learnt from; with no label to
learn from, or only one kind, every score is the base rate (0.5 without labels); of rows that share a doc_id one is learnt from; equal texts get equal scores; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

SAMPLE = 20_000
TREES = 40
DEPTH = 3
BINS = 32
CUT = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, none of which needs more than one pass over it."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    words, lines = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.split(t, "\n")
    return {
        "chars": F.length(t).cast("double"),
        "words": F.size(words).cast("double"),
        "distinct_words": F.size(F.array_distinct(words)).cast("double"),
        "lines": F.size(lines).cast("double"),
        "distinct_lines": F.size(F.array_distinct(lines)).cast("double"),
        "capital_runs": count("[A-Z]{2,}"),
        "symbols": count(r"[#*$%&|<>]+"),
        "bangs": count(r"[!?]{2,}"),
        "bars": count(r"\x20\|\x20"),
        "stops": count(r"[.,;:]+"),
        "digits": count("[0-9]+"),
    }


def features(raw: str = "raw") -> dict[str, Column]:
    """What rules are about: ratios of the statistics."""
    r = {k: F.col(raw)[k] for k in statistics(F.lit(""))}
    words = F.greatest(r["words"], F.lit(1.0))
    return {
        "log_words": F.log1p(r["words"]),
        "mean_word": r["chars"] / words,
        "distinct_share": r["distinct_words"] / words,
        "word_repeats": r["words"] / F.greatest(r["distinct_words"], F.lit(1.0)),
        "line_words": words / F.greatest(r["lines"], F.lit(1.0)),
        "line_repeats": r["lines"] / F.greatest(r["distinct_lines"], F.lit(1.0)),
        **{f"{k}_share": r[k] / words for k in ("capital_runs", "symbols", "bangs", "bars", "stops", "digits")},
    }


NAMES = ["log_words", "mean_word", "distinct_share", "word_repeats", "line_words", "line_repeats", "capital_runs_share", "symbols_share", "bangs_share", "bars_share", "stops_share", "digits_share"]


def with_features(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The carried columns and a struct `f` of the features."""
    raw = docs.select(*carry, F.struct(*(c.alias(k) for k, c in statistics(F.col("text")).items())).alias("raw"))
    return raw.select(*carry, F.struct(*(c.alias(k) for k, c in features().items())).alias("f"))


# ---- rules ----

Rule = tuple[tuple[int, bool, float], ...]  #: conditions: feature, whether it must be above, threshold


def _tree(binned: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, weight: np.ndarray, depth: int) -> tuple[np.ndarray, list[Rule]]:
    """One regression tree on the residuals: (its values, rules of all its nodes)."""
    value, rules = np.zeros(len(residual)), []

    def grow(rows: np.ndarray, path: Rule, left: int) -> None:
        if path:
            rules.append(path)
        g, h = residual[rows], weight[rows]
        best = (1e-6, -1, 0)
        if left and len(rows) >= 40:
            for j in range(binned.shape[1]):
                sg, sh, n = (np.cumsum(np.bincount(binned[rows, j], w, BINS)) for w in (g, h, np.ones(len(rows))))
                ok = (n >= 20) & (n[-1] - n >= 20)
                gain = np.where(ok, sg**2 / (sh + 1) + (sg[-1] - sg) ** 2 / (sh[-1] - sh + 1) - sg[-1] ** 2 / (sh[-1] + 1), 0)
                b = int(gain.argmax())
                if gain[b] > best[0] and b < len(cuts[j]):
                    best = (float(gain[b]), j, b)
        if best[1] < 0:
            value[rows] = g.sum() / (h.sum() + 1)
            return
        _, j, b = best
        above = binned[rows, j] > b
        for side in (False, True):
            grow(rows[above == side], (*path, (j, side, float(cuts[j][b]))), left - 1)

    grow(np.arange(len(residual)), (), depth)
    return value, rules


def boosted_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 11) -> list[Rule]:
    """Distinct rules of boosted trees, each grown on half of the rows and features."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    score, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rows, cols = rng.random(len(y)) < 0.5, np.sort(rng.permutation(x.shape[1])[: max(2, x.shape[1] * 2 // 3)])
        _, rules = _tree(binned[np.ix_(rows, cols)], [cuts[j] for j in cols], (y - p)[rows], (p * (1 - p))[rows], depth)
        rules = [tuple((int(cols[j]), side, cut) for j, side, cut in r) for r in rules]
        found.update(dict.fromkeys(rules))
        leaves = [r for r in rules if len(r) == depth]
        for r in leaves:
            on = holds(x, r)
            score[on] += 0.3 * (y - p)[on].sum() / ((p * (1 - p))[on].sum() + 1)
    return list(found)


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, cut in rule:
        out &= (x[:, j] > cut) if above else (x[:, j] <= cut)
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient steps."""
    n = len(y)
    step = 4.0 / (np.linalg.norm(z.T @ z / n, 2) + 1)
    w, b = np.zeros(z.shape[1]), float(np.log(y.mean() / (1 - y.mean())))
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ v + c)))
        nw = v - step * (z.T @ (p - y) / n)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = c - step * float((p - y).mean())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.002) -> tuple[list[Rule], np.ndarray, float]:
    """The rules that keep a weight, their weights, and the intercept."""
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return [], np.zeros(0), float(np.log(rate / (1 - rate)))
    rules = boosted_rules(x, y)
    if not rules:
        return [], np.zeros(0), float(np.log(y.mean() / (1 - y.mean())))
    z = np.stack([holds(x, r) for r in rules], axis=1)
    _, first = np.unique(z, axis=1, return_index=True)
    rules, z = [rules[i] for i in sorted(first)], z[:, sorted(first)].astype(np.float64)
    w, b = lasso_logistic(z, y, penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return [rules[i] for i in keep], w[keep], b


def compiled(rules: list[Rule], w: np.ndarray, b: float, f: Column) -> Column:
    """The ensemble as a column expression over the feature struct."""
    z = F.lit(float(b))
    for rule, weight in zip(rules, w, strict=True):
        test = F.lit(True)
        for j, above, cut in rule:
            test = test & ((f[NAMES[j]] > cut) if above else (f[NAMES[j]] <= cut))
        z = z + F.when(test, float(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[Rule], np.ndarray, float]:
    """Fits the ensemble to about `sample` labelled rows at most."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    share = min(1.0, sample / max(1, usable.count()))
    chosen = staged(usable.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)), "sample")  # about `sample` rows
    # of rows that share a doc_id one counts, so that the sample's bound holds for rows too
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = with_features(own, ["doc_id", "quality"]).select("quality", *(F.col("f")[n].alias(n) for n in NAMES), "doc_id").toPandas().sort_values(["doc_id", *NAMES])
    return fit(rows[NAMES].to_numpy(float), rows["quality"].to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    score = compiled(*learn(docs, labels, sample), F.col("f"))
    out = with_features(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
