"""Parameter grids, replications and their summaries."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.assignment import cheapest_assignment
from lamella.functions.scalars import mean_sd
from lamella.functions.small_graphs import SMALL, laplacian
from lamella.plans import exact

METRICS = ("error", "nmi", "ari")


def grid(spark: SparkSession, scenarios: Iterable[str], parameters: Iterable[float], repetitions: int) -> DataFrame:
    """(scenario, parameter, seed): every combination."""
    rows = [(s, float(p)) for s in scenarios for p in parameters]
    return spark.createDataFrame(rows, "scenario string, parameter double").withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))


#: What a study's parameter stands for.
VARIED = ("layers", "degree", "gap")


def draw(scenario: str, parameter: float, seed: int, n: int = 150, k: int = 3, degree: float = 10.0, vary: str = "layers", layers: int = 20) -> tuple[exact.Layers, np.ndarray]:
    """A planted graph in index form, and its communities. Scenarios as in operators.generate.

    vary: the parameter is the number of layers, the mean degree (of ``layers``
    layers), or the gap between a block's own density and the others.
    """
    from lamella.operators.generate import SCENARIOS

    if vary not in VARIED:
        raise ValueError(f"a study varies one of {', '.join(VARIED)}")
    rng = np.random.default_rng([seed, int(parameter * 1000)])
    own, many, gap = SCENARIOS[scenario], layers, 0.06
    if vary == "layers":
        many = int(parameter)
    elif vary == "degree":
        degree = parameter
    else:
        gap = parameter
    k = own.get("k", k)
    truth = np.arange(n) // -(-n // k)

    def weights(layer: int) -> np.ndarray:
        if own.get("theta") == "two":
            t = np.where(np.arange(n) % -(-n // k) < n // k // 2, 0.15, 0.8)
            t = t if layer % 2 == 0 else 0.95 - t
        else:
            t = rng.exponential(size=n) + 0.2
        return t / (np.bincount(truth, t, minlength=k) / np.bincount(truth, minlength=k))[truth]

    fixed, found = weights(0), []
    for layer in range(many):
        t = weights(layer) if own.get("theta_by_layer") or own.get("theta") == "two" else fixed
        b = np.full((k, k), 0.04) + gap * np.eye(k)
        if own.get("blocks") == "random":
            b = np.full((k, k), 0.04) + np.eye(k) * rng.random() * 0.2
        elif own.get("blocks") == "core":
            b = np.array([[1.0, 0.5], [0.5, 0.05]])
        elif own.get("blocks") == "deficient":
            b = np.full((k, k), 0.04)
            b[layer % k, layer % k] += 0.16 if vary != "gap" else gap
        p = np.outer(t, t) * b[np.ix_(truth, truth)]
        a = np.triu(rng.random((n, n)) < p * degree * n / p.sum(), 1)
        i, j = np.nonzero(a | a.T)
        found.append((i, j, np.ones(len(i))))
    return exact.Layers(n, found), truth


#: The joint solver under the names of the studies.
JOINT: dict[str, dict] = {
    "mfrost": {},
    "mfrost-random": {"init": "random"},
    "frost-dcmase": {"warm": "dcmase"},
    "frost-sharedZ": {"shared": True},
    "frost-sharedZ-Anorm": {"shared": True, "normalised": True},
    "us": {"rounds": 0},
}
#: Methods of the simulation studies, and how tables show them (fixed values).
STUDIED = {
    "mfrost": "mFROST", "dcmase": "DC-MASE", "ave_spherical": "Sum A", "sq-bias-adjusted": "Bias-adjusted SoS", "mase-spherical": "MASE", "lmfo": "OLMF", "frost-sharedZ": "mFROST-Zshared", "frost-sharedZ-Anorm": "mFROST-Zshared-L", "csnmtf": "CSNMTF",
}
#: Methods of the study of real networks.
REAL = ("mfrost", "dcmase", "ave_spherical", "sq-bias-adjusted", "mase-spherical", "csnmtf", "lmfo")


def solved(name: str, g: exact.Layers, r: int, seed: int, **options) -> np.ndarray:
    """Labels of a small graph by a method of JOINT or functions.small_graphs."""
    if name in SMALL:
        return SMALL[name]([g.layer(i).dense() for i in range(g.l)], r, seed)
    if name not in JOINT:
        raise ValueError(f"unknown method {name!r}; known: {', '.join([*JOINT, *SMALL])}")
    own = JOINT[name] | options
    warm, normalised = own.pop("warm", None), own.pop("normalised", False)
    if normalised:
        scaled = [laplacian(g.layer(i).dense()) for i in range(g.l)]
        g = exact.Layers(g.n, [(*np.nonzero(x), x[np.nonzero(x)]) for x in scaled])
    start = SMALL[warm]([g.layer(i).dense() for i in range(g.l)], r, seed) if warm else None
    return exact.best_of(g, exact.Options(r=r, seed=seed, **({"trials": 1} if warm else {}) | own), start).v


def scores(found: np.ndarray, truth: np.ndarray) -> tuple[float, float, float]:
    """(error, nmi, ari) of labels."""
    a, b = np.unique(found, return_inverse=True)[1], np.unique(truth, return_inverse=True)[1]
    k = max(a.max(), b.max()) + 1
    t = np.zeros((k, k))
    np.add.at(t, (a, b), 1)
    n = t.sum()
    x, y = t.sum(axis=1), t.sum(axis=0)
    with np.errstate(all="ignore"):
        mi = np.nansum(t / n * np.log(t * n / np.outer(x, y)))
        hx, hy = -np.nansum(x / n * np.log(x / n)), -np.nansum(y / n * np.log(y / n))
    pairs = lambda v: (v * (v - 1) / 2).sum()
    expected = pairs(x) * pairs(y) / (n * (n - 1) / 2)
    most = (pairs(x) + pairs(y)) / 2
    return float(1 + cheapest_assignment(-t)[1] / n), float(2 * mi / (hx + hy)) if hx + hy > 0 else 1.0, float((pairs(t) - expected) / (most - expected)) if most != expected else 1.0


def simulate(cells: DataFrame, methods: Iterable[str] | dict[str, exact.Options], vary: str = "layers", n: int = 150, **options) -> DataFrame:
    """(scenario, parameter, seed, method, error, nmi, ari): a task for each cell of the grid and method, by names or by options of the joint solver."""
    given = methods if isinstance(methods, dict) else {}
    spread = cells.withColumn("method", F.explode(F.array(*map(F.lit, methods))))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x in rows.itertuples():
            g, truth = draw(x.scenario, x.parameter, x.seed, n, vary=vary)
            labels = exact.best_of(g, given[x.method]).v if x.method in given else solved(x.method, g, truth.max() + 1, x.seed, **options)
            out.append((x.scenario, x.parameter, x.seed, x.method, *scores(labels, truth)))
        return pd.DataFrame(out, columns=["scenario", "parameter", "seed", "method", *METRICS])

    return spread.groupBy("scenario", "parameter", "seed", "method").applyInPandas(run, "scenario string, parameter double, seed int, method string, error double, nmi double, ari double")


def main_study(spark: SparkSession, repetitions: int = 100, layers: Iterable[int] = (1, 2, 3, 5, 7, 10, 15, 20, 30, 40, 50), methods: Iterable[str] = tuple(STUDIED), scenarios: Iterable[str] = ("sim1", "sim2", "sim3", "sim4", "sim6", "sim7")) -> DataFrame:
    """Scores by the number of layers."""
    return simulate(grid(spark, scenarios, layers, repetitions), methods)


def sparsity_study(spark: SparkSession, repetitions: int = 100, degrees: Iterable[int] = tuple(range(2, 25, 2)), methods: Iterable[str] = tuple(STUDIED), scenarios: Iterable[str] = ("sim1", "sim2", "sim3", "sim4", "sim6", "sim7")) -> DataFrame:
    """Scores by the mean degree, of twenty layers."""
    return simulate(grid(spark, scenarios, degrees, repetitions), methods, "degree")


def _trials(edges: DataFrame, labels: DataFrame, tags: DataFrame, run, schema: str) -> DataFrame:
    """``run(tag, graph, known)`` for every row of ``tags``, a task each that holds the graph; known: labels from 0, -1 for none."""
    layers = [r.layer for r in edges.select("layer").distinct().orderBy("layer").collect()]
    names = tags.columns
    rows = edges.select("layer", "src", "dst", "weight").unionByName(labels.select(F.lit(None).cast("string").alias("layer"), F.col("node").alias("src"), F.col("label").cast("long").alias("dst"), F.lit(0.0).alias("weight")))

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = frame[frame["layer"].isna()].sort_values("src")
        nodes = own["src"].to_numpy()
        inner = frame[frame["layer"].notna()].sort_values(["src", "dst"])
        parts = []
        for layer in layers:
            x = inner[inner["layer"] == layer]
            parts.append((np.searchsorted(nodes, x["src"].to_numpy()), np.searchsorted(nodes, x["dst"].to_numpy()), x["weight"].to_numpy(float)))
        known = own["dst"].to_numpy(dtype=float)
        found = np.full(len(nodes), -1)
        some = ~np.isnan(known)
        found[some] = np.unique(known[some], return_inverse=True)[1]
        made = run(dict(zip(names, key, strict=True)), exact.Layers(len(nodes), parts), found)
        return pd.DataFrame([(*key, *r) for r in made], columns=[*names, *(c.split(" ")[0] for c in schema.split(", "))])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tags.schema.fields)
    return rows.crossJoin(F.broadcast(tags)).groupBy(*names).applyInPandas(solve, f"{kinds}, {schema}")  # a few rows


def real_study(edges: DataFrame, labels: DataFrame, methods: Iterable[str] = REAL, trials: int = 10, seed: int = 8, **options) -> DataFrame:
    """(method, trial, error, nmi, ari) on a graph with known labels (node, label): as many communities as distinct labels; nodes without one do not count."""
    tags = edges.sparkSession.createDataFrame([(m, t) for m in methods for t in range(trials)], "method string, trial int")

    def run(tag, g, known):
        found = solved(tag["method"], g, int(known.max()) + 1, seed + tag["trial"], **(options if tag["method"] in JOINT else {}))
        return [scores(found[known >= 0], known[known >= 0])]

    return _trials(edges, labels, tags, run, "error double, nmi double, ari double")


def convergence_study(edges: DataFrame, labels: DataFrame, trials: int = 10, rounds: int = 30, seed: int = 101, starts: Iterable[str] = ("usenc", "random")) -> DataFrame:
    """(start, trial, iteration, error, nmi, ari): a fixed number of sweeps from each kind of start, without a stop."""
    tags = edges.sparkSession.createDataFrame([(s, t) for s in starts for t in range(trials)], "start string, trial int")

    def run(tag, g, known):
        options = exact.Options(r=int(known.max()) + 1, rounds=rounds, delta=0.0, init=tag["start"], seed=seed)
        fit = exact.trial(g, options, tag["trial"], watched=True)
        return [(h[0], h[2], *scores(v[known >= 0], known[known >= 0])[1:]) for h, v in zip(fit.history, fit.labels, strict=True)]

    return _trials(edges, labels, tags, run, "iteration int, error double, nmi double, ari double")


def scalability_study(edges: DataFrame, labels: DataFrame, trials: int = 10, seed: int = 101) -> DataFrame:
    """(trial, iterations, seconds, error, nmi, ari) of whole fits."""
    tags = edges.sparkSession.createDataFrame([(t,) for t in range(trials)], "trial int")

    def run(tag, g, known):
        fit = exact.trial(g, exact.Options(r=int(known.max()) + 1, seed=seed), tag["trial"])
        return [(len(fit.history), fit.history[-1][1] if fit.history else 0.0, fit.error, *scores(fit.v[known >= 0], known[known >= 0])[1:])]

    return _trials(edges, labels, tags, run, "iterations int, seconds double, error double, nmi double, ari double")


def report(results: DataFrame, by: list[str], metrics: Iterable[str]) -> DataFrame:
    """``mean ± sd`` of each metric by group, as text."""
    both = results.groupBy(*by).agg(*(f(m).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"))))
    return both.select(*by, *(mean_sd(F.col(f"{m}_mean"), F.coalesce(f"{m}_sd", F.lit(0.0))).alias(m) for m in metrics))


def summary(results: DataFrame, by: list[str], metrics: Iterable[str] = METRICS, digits: int = 4) -> DataFrame:
    """Mean and standard deviation of each metric by group; missing values do not count."""
    return results.groupBy(*by).agg(*(F.round(f(m), digits).alias(f"{m}_{n}") for m in metrics for f, n in ((F.avg, "mean"), (F.stddev_samp, "sd"))))


def mean_sd_se(results: DataFrame, by: list[str], value: str) -> DataFrame:
    """(…, mean, sd, se): the standard error divides by the number of rows, missing ones included."""
    return results.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("se"))


def wider(results: DataFrame, by: list[str], methods: list[str], value: str) -> DataFrame:
    """A column for each method."""
    return results.groupBy(*by).pivot("method", methods).agg(F.first(value))


def longer(results: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(…, metric, value): a row for each metric."""
    return results.unpivot(by, metrics, "metric", "value")


def convergence(history: DataFrame) -> DataFrame:
    """By iteration over the trials: mean, sd, least and largest error."""
    return history.groupBy("iteration").agg(F.avg("error").alias("mean"), F.stddev_samp("error").alias("sd"), F.min("error").alias("least"), F.max("error").alias("most"))


def final_states(history: DataFrame) -> DataFrame:
    """(trial, iterations, error): the last row of each trial."""
    return history.groupBy("trial").agg(F.max("iteration").alias("iterations"), F.max_by("error", "iteration").alias("error"))
