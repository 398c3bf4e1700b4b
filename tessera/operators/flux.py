"""Constraint-based models: scenarios, flux balance, flux sampling and flux features.

Models are long tables: stoich(met, rxn, coef), reactions(rxn, lb, ub, c), metabolites(met, b). The solver and sampler work on one
scenario (and chain) per task, as a model is a few thousand reactions; scenarios and chains spread over the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import vectors as V
from tessera.functions.text import number_token
from tessera.operators.interior import Sparse, maximize_sparse

# The two reactions and the fractions of their upper bounds.
SCENARIO_REACTIONS = {"G6PDH2": (0.1, 0.28, 0.5), "EX_h2o2_e": (1.0, 0.75, 0.5)}
CHAINS, SAMPLES = 3, 2000


def scenario_grid(spark: SparkSession, fractions: dict[str, tuple[float, ...]] = SCENARIO_REACTIONS) -> DataFrame:
    """Nine scenarios with the fraction of each reaction and a name for files."""
    (a, fa), (b, fb) = fractions.items()
    grid = spark.createDataFrame([(x,) for x in fa], "f1 double").crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in fb], "f2 double")))
    return grid.select(F.concat(F.lit("G6PD_"), number_token(F.col("f1")), F.lit("_h2o2_"), number_token(F.col("f2"))).alias("scenario"), F.lit(a).alias("rxn1"), "f1", F.lit(b).alias("rxn2"), "f2")


def perturb(reactions: DataFrame, grid: DataFrame) -> DataFrame:
    """Reactions of every scenario, the upper bounds of the two scaled by their fractions. The grid has a handful of rows."""
    ub = F.when(F.col("rxn") == F.col("rxn1"), F.col("ub") * F.col("f1")).when(F.col("rxn") == F.col("rxn2"), F.col("ub") * F.col("f2")).otherwise(F.col("ub"))
    return reactions.crossJoin(F.broadcast(grid)).select("scenario", "rxn", "lb", ub.alias("ub"), "c")


def _matrix(stoich: pd.DataFrame, rxns: list[str], mets: list[str]) -> np.ndarray:
    s = np.zeros((len(mets), len(rxns)))
    at_met, at_rxn = {m: i for i, m in enumerate(mets)}, {r: i for i, r in enumerate(rxns)}
    for m, r, c in stoich[["met", "rxn", "coef"]].itertuples(index=False):
        s[at_met[m], at_rxn[r]] += c
    return s


#: Pivots after which the basis is inverted anew.
REFRESH = 64


def maximize(c: np.ndarray, a: np.ndarray, b: np.ndarray, lb: np.ndarray, ub: np.ndarray, tol: float = 1e-9) -> tuple[str, np.ndarray]:
    """(status, x) of max c x with a x = b and lb <= x <= ub: two-phase revised simplex with bounds.

    The basis' inverse is updated at each pivot and made anew now and then, so a pivot costs m squared for m rows. The greatest reduced cost
    enters; after pivots that gain nothing, the first one does (Bland's rule), so that no cycle lasts.
    """
    m, n = a.shape
    if np.any(lb > ub + tol):
        return "infeasible", np.full(n, np.nan)
    x0 = np.where(np.isfinite(lb), lb, np.where(np.isfinite(ub), ub, 0.0))
    gap = b - a @ x0
    full = np.hstack([a, np.diag(np.where(gap < 0, -1.0, 1.0))])
    low, high = np.concatenate([lb, np.zeros(m)]), np.concatenate([ub, np.full(m, np.inf)])
    x = np.concatenate([x0, np.abs(gap)])
    basis = np.arange(n, n + m)
    inside = np.concatenate([np.zeros(n, bool), np.ones(m, bool)])

    def run(cost: np.ndarray) -> str:
        inverse, idle = np.linalg.pinv(full[:, basis]), 0
        for step in range(200 * (n + m) + 1000):
            if step % REFRESH == REFRESH - 1:
                inverse = np.linalg.pinv(full[:, basis])
                x[basis] = inverse @ (b - full[:, ~inside] @ x[~inside])
            reduced = np.where(inside, 0.0, cost - (cost[basis] @ inverse) @ full)
            gain = np.where((reduced > tol) & (x < high - tol) | (reduced < -tol) & (x > low + tol), np.abs(reduced), 0.0)
            if not gain.any():
                return "optimal"
            j = int(np.flatnonzero(gain)[0] if idle > 2 * m else gain.argmax())
            way = 1.0 if reduced[j] > 0 else -1.0
            column = inverse @ full[:, j]
            move = column * way
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(move > tol, (x[basis] - low[basis]) / move, np.where(move < -tol, (high[basis] - x[basis]) / -move, np.inf))
            room = np.maximum(room, 0.0)
            limit, leave = high[j] - low[j], -1
            if m and room.min() < limit:
                limit = room.min()
                ties = np.flatnonzero(room <= limit + tol)
                leave = int(ties[basis[ties].argmin()] if idle > 2 * m else ties[np.abs(move[ties]).argmax()])
            if not np.isfinite(limit):
                return "unbounded"
            idle = idle + 1 if limit <= tol else 0
            x[j] += way * limit
            x[basis] -= move * limit
            if leave >= 0:
                inside[basis[leave]], inside[j] = False, True
                basis[leave] = j
                row = inverse[leave] / column[leave]
                inverse = inverse - np.outer(column, row)
                inverse[leave] = row
        return "iterations"

    run(np.concatenate([np.zeros(n), -np.ones(m)]))
    if x[n:].sum() > 1e-6 * max(1.0, np.abs(b).max(initial=0.0), np.abs(gap).max(initial=0.0)):
        return "infeasible", np.full(n, np.nan)
    high[n:] = 0.0
    x[n:] = 0.0
    return run(np.concatenate([c, np.zeros(m)])), x[:n]


#: Rows of a model up to which the simplex solves it; larger ones go to the interior point method.
SIMPLEX_ROWS = 400


def flux_balance(reactions: DataFrame, stoich: DataFrame, metabolites: DataFrame, solver: str | None = None) -> DataFrame:
    """(scenario, status, objective, rxn, v): the flux with the greatest objective in each scenario.

    Each scenario's entries meet in one task, as a sparse matrix. solver is simplex or interior, by the model's size if it is not given:
    the simplex gives a vertex, the interior point method a flux inside of the optimal ones, with the same objective. Entries of one
    place add up; those of unknown reactions or metabolites are left out.
    """
    if solver not in (None, "simplex", "interior"):
        raise ValueError("solver is simplex or interior")
    of = reactions.select("scenario", "rxn", F.col("lb").cast("double").alias("lb"), F.col("ub").cast("double").alias("ub"), F.col("c").cast("double").alias("c"))
    entries = of.join(stoich.select("rxn", "met", F.col("coef").cast("double").alias("coef")), "rxn", "left").select("scenario", "rxn", "lb", "ub", "c", "met", "coef")
    names = reactions.select(F.col("scenario").alias("of_scenario")).distinct()
    mets = metabolites.select(F.col("met").alias("row"), F.col("b").cast("double").alias("b")).join(F.broadcast(names))  # scenarios are a handful

    def solve(key: tuple, rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        ends = ends.sort_values("row")
        own = rows[["rxn", "lb", "ub", "c"]].drop_duplicates("rxn").sort_values("rxn")
        i, j = pd.Index(ends["row"]).get_indexer(rows["met"]), pd.Index(own["rxn"]).get_indexer(rows["rxn"])
        some = (i >= 0) & rows["coef"].notna().to_numpy()
        a = Sparse(i[some], j[some], rows["coef"].to_numpy(float)[some], (len(ends), len(own)))
        c, lb, ub, b = own["c"].to_numpy(float), own["lb"].to_numpy(float), own["ub"].to_numpy(float), ends["b"].to_numpy(float)
        if solver == "interior" or solver is None and len(ends) > SIMPLEX_ROWS:
            status, x = maximize_sparse(c, a, b, lb, ub)
        else:
            full = np.zeros(a.shape)
            np.add.at(full, (a.rows, a.columns), a.values)
            status, x = maximize(c, full, b, lb, ub)
        return pd.DataFrame({"scenario": key[0], "status": status, "objective": float(c @ x), "rxn": own["rxn"].to_list(), "v": x})

    solved = entries.groupBy("scenario").cogroup(mets.groupBy("of_scenario"))
    return solved.applyInPandas(solve, "scenario string, status string, objective double, rxn string, v double")


def sample_fluxes(reactions: DataFrame, stoich: DataFrame, metabolites: DataFrame, chains: int = CHAINS, samples: int = SAMPLES, seed: int = 7, thin: int = 10) -> DataFrame:
    """(scenario, chain, sample_id, flux): hit-and-run samples of the flux polytope, flux in the order of reaction names.

    Seeded by scenario and chain, so a task run again draws the same; a statistical equivalent of other samplers, not the same draws.
    Each chain starts at the mean of optima in random directions and moves in the null space of the stoichiometry.
    """
    spark = reactions.sparkSession
    shared = spark.sparkContext.broadcast((stoich.toPandas(), metabolites.toPandas()))
    spread = reactions.crossJoin(F.broadcast(spark.range(1, chains + 1).select(F.col("id").cast("int").alias("chain"))))

    def draw(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s, mets = shared.value
        rows = rows.sort_values("rxn")
        names = sorted(mets["met"])
        a = _matrix(s, list(rows["rxn"]), names)
        b = mets.set_index("met")["b"].reindex(names).to_numpy(float)
        lb, ub = rows["lb"].to_numpy(float), rows["ub"].to_numpy(float)
        rng = np.random.default_rng([seed, int(key[1]), *key[0].encode()])
        found = [x for status, x in (maximize(rng.normal(size=len(lb)), a, b, lb, ub) for _ in range(max(6, min(2 * len(lb), 40)))) if status == "optimal"]
        if not found:
            return pd.DataFrame({"scenario": [], "chain": [], "sample_id": [], "flux": []})
        x = np.mean(found, axis=0)
        _, sv, vt = np.linalg.svd(a)
        free = vt[(sv > 1e-9).sum() :]
        out = []
        for k in range(samples * thin):
            d = free.T @ rng.normal(size=len(free)) if len(free) else np.zeros(len(lb))
            some = np.abs(d) > 1e-12
            ends = np.stack([(lb[some] - x[some]) / d[some], (ub[some] - x[some]) / d[some]])
            lo, hi = (ends.min(0).max(), ends.max(0).min()) if some.any() else (0.0, 0.0)
            x = np.clip(x + d * rng.uniform(min(lo, 0.0), max(hi, 0.0)), lb, ub)
            if (k + 1) % thin == 0:
                out.append(x.copy())
        return pd.DataFrame({"scenario": key[0], "chain": int(key[1]), "sample_id": np.arange(len(out)), "flux": out})

    return spread.groupBy("scenario", "chain").applyInPandas(draw, "scenario string, chain int, sample_id int, flux array<double>")


def flux_features(samples: DataFrame, column: str = "flux", reference: str | None = None) -> DataFrame:
    """Norms, sparsity and entropy of each vector and, if there is a reference column, distances to it.

    The column holds a vector, or a matrix (an array for each reaction) whose columns are samples; these give a row each, numbered by `sample`.
    """
    if samples.schema[column].dataType.simpleString() == "array<array<double>>":
        transposed = F.transform(F.sequence(F.lit(0), F.size(F.get(column, F.lit(0))) - 1), lambda j: F.transform(column, lambda r: F.get(r, j)))
        samples = samples.select(*[c for c in samples.columns if c != column], F.posexplode(transposed).alias("sample", column))
    v = F.col(column)
    out = [V.l1(v).alias("l1"), V.l2(v).alias("l2"), V.linf(v).alias("linf"), V.sparsity(v).alias("sparsity"), V.entropy(v).alias("entropy")]
    if reference:
        r = F.col(reference)
        d = V.minus(v, r)
        out += [V.l1(d).alias("d_l1"), V.l2(d).alias("d_l2"), V.linf(d).alias("d_linf"), V.cosine_distance(v, r).alias("d_cosine"), V.pearson(v, r).alias("pearson")]
    return samples.select(*[c for c in samples.columns if c not in (column, reference)], *out)


def metabolite_production(fluxes: DataFrame, stoich: DataFrame, mets: list[str] | None = None) -> DataFrame:
    """(keys, met, produced, net): what fluxes (…, rxn, v) make of each metabolite, or of those named."""
    keys = [c for c in fluxes.columns if c not in ("rxn", "v")]
    made = fluxes.join(stoich if mets is None else stoich.where(F.col("met").isin(mets)), "rxn").withColumn("x", F.col("coef") * F.col("v"))
    return made.groupBy(*keys, "met").agg(F.sum(F.greatest("x", F.lit(0.0))).alias("produced"), F.sum("x").alias("net"))


def pathway_usage(fluxes: DataFrame, pathways: DataFrame) -> DataFrame:
    """(keys, pathway, usage, share) of absolute flux by pathway (rxn, pathway)."""
    keys = [c for c in fluxes.columns if c not in ("rxn", "v")]
    used = fluxes.join(pathways, "rxn").groupBy(*keys, "pathway").agg(F.sum(F.abs("v")).alias("usage"))
    return used.withColumn("share", F.col("usage") / F.sum("usage").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))))


def chain_rhat(samples: DataFrame, value: str, group: list[str], chain: str = "chain") -> DataFrame:
    """Gelman-Rubin statistic of a value over chains, by group; chains of unlike lengths count by their mean length."""
    per = samples.groupBy(*group, chain).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    out = per.groupBy(*group).agg(F.avg("n").alias("n"), F.avg("v").alias("within"), F.var_samp("m").alias("between"), F.count("*").alias("n_chains"))
    return out.select(*group, "n_chains", "within", "between", F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("within") + F.col("between")) / F.col("within")).alias("rhat"))


#: Sums of tasks are merged in so many groups, which the driver adds up.
MERGED = 16


def mahalanobis(samples: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    """Distance of each vector to the reference's mean, by the pseudo-inverse of its covariance; null without any reference, or for a null vector.

    Each task sums vectors and their products about the first vector into one row, and MERGED rows of them reach the driver, which
    inverts a matrix as wide as a vector is long.
    """
    first = reference.where(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("v")).first()
    if first is None:
        return samples.withColumn("mahalanobis", F.lit(None).cast("double"))
    about = np.array(first.v)
    d = len(about)

    def added(batches):
        n, total, products = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy()) - about
                n, total, products = n + len(x), total + x.sum(0), products + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [total], "p": [products.ravel()]})

    def merged(parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [parts["n"].sum()], "s": [np.sum(parts["s"].to_list(), axis=0)], "p": [np.sum(parts["p"].to_list(), axis=0)]})

    kind = "n long, s array<double>, p array<double>"
    parts = reference.where(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("v")).mapInPandas(added, kind)
    sums = parts.groupBy(F.spark_partition_id() % MERGED).applyInPandas(merged, kind).toPandas()
    n = int(sums["n"].sum())
    shift = np.sum(sums["s"].to_list(), axis=0) / n
    mean = about + shift
    cov = (np.sum(sums["p"].to_list(), axis=0).reshape(d, d) - n * np.outer(shift, shift)) / max(1, n - 1)
    inverse = np.linalg.pinv(cov)

    @F.pandas_udf("double")
    def distance(v: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=v.index)
        known = v.notna()
        if known.any():
            x = np.stack(v[known].to_numpy()) - mean
            out[known] = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, inverse, x), 0))
        return out.astype(object).where(known, None)

    return samples.withColumn("mahalanobis", distance(F.col(column)))
