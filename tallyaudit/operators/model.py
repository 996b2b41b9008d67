"""One-class anomaly model over 14 features per sheet.

The RBF boundary lives in the span of landmark rows (Nystroem features). Training is a sequence of distributed
passes: each ships a few hundred model numbers to the tasks and brings back one vector of the same size, so neither
the driver nor any task ever holds the data. The passes end when the duality gap is small.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.explain import explanation
from ..functions.values import score_confidence, score_normalized
from ..session import cut_lineage
from .history import latest_per_key
from .sums import line_sums

FEATURES = ["party_votes", "blank", "null", "challenged", "emitted", "electors", "turnout", "null_ratio",
            "blank_ratio", "discrepancy", "type_d", "scan_score", "artificial_score", "alerts"]

# Defaults of missing inputs.
DEFAULT_ELECTORS, DEFAULT_TURNOUT, NO_COMPARISON, DEFAULT_SCAN = 300.0, 0.5, 0.5, 50.0
MIN_ROWS = 5
#: Raw scores are compared at this many digits: their last bits depend on the batch.
DIGITS = 12
#: Rows lifted at a time, so that their lifted vectors stay in the processor's cache. A product's last bits depend on a
#: row's place modulo four, so blocks are a multiple of it and the last one has four rows at least.
BLOCK = 256
#: Rows of the sample that bounds the quantile of a table with more than so many rows.
BOUNDED_FROM, SAMPLE = 200_000, 16_384


def _clean(c: Column) -> Column:
    d = c.cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    return F.when(bad, 0.0).otherwise(d)


def features(sheets: DataFrame, lines: DataFrame, compares: DataFrame | None = None,
             reports: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """Feature columns per sheet.

    ``compat`` reproduces the defaults that result when the published document lacks the vote
    fields: no vote counts, 300 electors, no turnout.
    """
    zero = F.lit(0.0)
    j = sheets.select("sheet_id", "station", "contest_id", "emitted", "eligible")
    if compat:
        j = j.withColumns({c: zero for c in ("sum_valid", "blanks", "nulls", "challenged")})
        electors, voters = F.lit(DEFAULT_ELECTORS), zero
    else:
        j = j.join(line_sums(lines), "sheet_id", "left")
        electors = F.coalesce(F.col("eligible").cast("double"), F.lit(DEFAULT_ELECTORS))
        voters = F.coalesce(F.col("emitted").cast("double"), zero)
    if compares is not None:
        c = latest_per_key(compares, ["sheet_id"], "ts", "compare_id").select(
            "sheet_id", F.when(F.col("status") == "alerta", 1.0).otherwise(0.0).alias("_disc"))
        j = j.join(c, "sheet_id", "left")
    else:
        j = j.withColumn("_disc", F.lit(None).cast("double"))
    if reports is not None:
        r = latest_per_key(reports, ["sheet_id"], "ts", "report_id").select(
            "sheet_id", *[c for c in ("classification", "scan_score", "artificial_score", "alerts")
                          if c in reports.columns])
        j = j.join(r, "sheet_id", "left")

    def report(col: str, value: Column, default: float) -> Column:
        return F.coalesce(value, F.lit(default)) if col in j.columns else F.lit(default)

    party, blank, null, challenged = (F.coalesce(F.col(c).cast("double"), zero)
                                      for c in ("sum_valid", "blanks", "nulls", "challenged"))
    declared = F.coalesce(F.col("emitted").cast("double"), zero)
    emitted = F.when(declared == 0, party + blank + null + challenged).otherwise(declared)
    exprs = {
        "party_votes": party, "blank": blank, "null": null, "challenged": challenged, "emitted": emitted,
        "electors": electors,
        "turnout": F.when(electors > 0, F.try_divide(voters, electors)).otherwise(DEFAULT_TURNOUT),
        "null_ratio": F.coalesce(F.try_divide(null, emitted), zero),
        "blank_ratio": F.coalesce(F.try_divide(blank, emitted), zero),
        "discrepancy": F.coalesce("_disc", F.lit(NO_COMPARISON)),
        "type_d": report("classification", F.when(F.col("classification") == "D", 1.0).otherwise(0.0)
                         if "classification" in j.columns else zero, 0.0),
        "scan_score": report("scan_score", F.col("scan_score").cast("double")
                             if "scan_score" in j.columns else zero, DEFAULT_SCAN),
        "artificial_score": report("artificial_score", F.col("artificial_score").cast("double")
                                   if "artificial_score" in j.columns else zero, 0.0),
        "alerts": report("alerts", F.size(F.filter("alerts", lambda a: a["nivel"] == "alerta")).cast("double")
                         if "alerts" in j.columns else zero, 0.0),
    }
    return j.select("sheet_id", "station", "contest_id", *[_clean(e).alias(n) for n, e in exprs.items()])


@dataclass
class Boundary:
    """Scaler and boundary over the numbers that ``lift`` makes of a row; a few thousand numbers at most."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    rho: float
    nu: float
    n: int

    def lift(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def lifted(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Lifted vectors and raw scores of the rows in order, block by block."""
        edges = [*range(0, max(len(x) - 3, 1), BLOCK), len(x)]
        for start, end in zip(edges, edges[1:]):
            z = self.lift(x[start:end])
            yield z, z @ self.weights

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([raw for _, raw in self.lifted(x)])

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Signed distance on the scale of the dual solution, negative = anomalous."""
        return (self.raw(x) - self.rho) * (self.nu * self.n)


@dataclass
class OneClassModel(Boundary):
    """Random Fourier features."""

    directions: np.ndarray
    offsets: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.directions + self.offsets
        return np.sqrt(2.0 / len(self.offsets)) * np.cos(z)


@dataclass
class LandmarkModel(Boundary):
    """RBF kernel values to the landmarks (scaled rows); ``gap`` is the relative duality gap that training ended with."""

    landmarks: np.ndarray
    gamma: float
    gap: float = np.inf

    def lift(self, x: np.ndarray) -> np.ndarray:
        return rbf((x - self.mean) / self.scale, self.landmarks, self.gamma)


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)
    products = x @ y.T
    products *= 2.0
    d -= products
    np.maximum(d, 0.0, out=d)
    d *= -gamma
    return np.exp(d, out=d)


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[FEATURES].to_numpy(dtype="float64")


def fit_one_class(feats: DataFrame, nu: float = 0.05, landmarks: int = 256, epochs: int = 60,
                  tol: float = 1e-3, written: bool = False) -> LandmarkModel:
    """The boundary with a share ``nu`` of the rows outside, in the span of ``landmarks`` rows.

    Every pass finds the mean of the ``nu`` share of rows that score lowest (an extreme point of the dual's feasible
    set); the weights become the point of least norm in the hull of the means found so far. The mean also gives the
    duality gap of the weights before it. Training ends at a gap of ``tol`` times the squared norm, or after ``epochs``
    passes. A large table is lifted once per pass: the few rows near the boundary, within bounds that a sample gives, are
    written and looked at again, the rows below them only summed (:func:`_near_boundary`). The features are written once to the checkpoint folder first, unless ``written`` says that ``feats`` is a
    table already.
    """
    data = feats.select("sheet_id", *FEATURES)
    data = data if written else cut_lineage(data)
    row = data.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in FEATURES],
                   *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES]).first()
    if row["n"] < MIN_ROWS:
        raise ValueError(f"at least {MIN_ROWS} sheets are needed, got {row['n']}")
    std = np.array([row[f"s_{c}"] for c in FEATURES])
    model = LandmarkModel(
        mean=np.array([row[f"m_{c}"] for c in FEATURES]), scale=np.where(std > 0, std, 1.0), weights=np.zeros(0),
        rho=0.0, nu=nu, n=row["n"], landmarks=np.zeros((0, len(FEATURES))), gamma=1.0 / max(int((std > 0).sum()), 1))
    model.landmarks = _landmarks(data, model, landmarks)
    model.weights = np.zeros(len(model.landmarks))
    inverse = np.linalg.pinv(rbf(model.landmarks, model.landmarks, model.gamma), rcond=1e-10, hermitian=True)
    sample = _matrix(_sample(data, model.n)) if model.n > BOUNDED_FROM else None
    atoms, point = np.zeros((0, len(model.landmarks))), np.zeros(len(model.landmarks))
    rows, below = data, np.zeros(len(model.landmarks) + 1)
    for _ in range(epochs):
        lowest = _lowest_mean(rows, model, below)
        norm = point @ model.weights
        model.gap = float((norm - lowest @ model.weights) / norm) if len(atoms) else np.inf
        if model.gap <= tol:
            break
        atoms = np.vstack([atoms, lowest])
        point = _least_norm(atoms @ inverse @ atoms.T) @ atoms
        model.weights = inverse @ point
        rows, below, share = _near_boundary(data, model, sample)
        model.rho = _quantile(rows, model, share)
    return model


def _sample(data: DataFrame, n: int) -> pd.DataFrame:
    """About SAMPLE rows by hash of the key; few or many of them only make the bounds worse, not the result."""
    hashed = data.where(F.pmod(F.xxhash64(F.col("sheet_id")), F.lit(max(1, n // SAMPLE))) == 0)
    return hashed.select(*FEATURES).limit(2 * SAMPLE).toPandas()


def _near_boundary(data: DataFrame, model: Boundary, sample: np.ndarray | None) -> tuple[DataFrame, np.ndarray, float]:
    """Rows among which the ``nu`` quantile of all raw scores lies, the summed lifted vectors and number of the rows that score
    lower, and the share of the former that scores up to it. All rows, where there is no sample or its bounds miss."""
    dims = len(model.weights)
    whole = data, np.zeros(dims + 1), model.nu
    if sample is None or not len(sample):
        return whole
    # Five standard deviations of a sample's rank on either side.
    reach = 5.0 * np.sqrt(model.nu * (1.0 - model.nu) / len(sample))
    low, high = np.quantile(model.raw(sample), np.clip([model.nu - reach, model.nu + reach], 0.0, 1.0))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(dims + 1)
        for pdf in batches:
            x, raws = _matrix(pdf), []
            for z, raw in model.lifted(x):
                raws.append(np.round(raw, DIGITS))
                part = z[raws[-1] < low]
                total += np.append(part.sum(axis=0), len(part))
            raw = np.concatenate(raws)
            yield pd.DataFrame(x[(raw >= low) & (raw <= high)], columns=FEATURES).assign(j=-1, v=np.nan)
        yield pd.DataFrame({"j": np.arange(dims + 1), "v": total}).assign(**dict.fromkeys(FEATURES, np.nan))

    found = cut_lineage(data.mapInPandas(split, ", ".join(f"`{c}` double" for c in FEATURES) + ", j int, v double"))
    rows = found.where("j = -1").select(*FEATURES)
    sums = found.groupBy("j").agg(F.when(F.col("j") < 0, F.count("*")).otherwise(F.sum("v")).alias("v")).collect()
    sums = {r["j"]: r["v"] for r in sums}
    below = np.array([sums[j] for j in range(dims + 1)])
    share = (model.nu * model.n - below[-1]) / sums.get(-1, np.inf)
    return (rows, below, float(share)) if 0.0 < share <= 1.0 else whole


def _landmarks(data: DataFrame, model: LandmarkModel, k: int) -> np.ndarray:
    """Up to ``k`` scaled rows of a sample of 4 k rows by hash of the key, each the one that those before it explain
    least (pivoted Cholesky); every different row if there are few."""
    sample = data.orderBy(F.xxhash64(F.col("sheet_id")), "sheet_id").limit(4 * k).toPandas()
    x = np.unique((_matrix(sample) - model.mean) / model.scale, axis=0)
    left, basis, chosen = np.ones(len(x)), np.zeros((len(x), 0)), []
    while len(chosen) < k and left.max() > 1e-8:
        i = int(left.argmax())
        column = (rbf(x, x[i : i + 1], model.gamma)[:, 0] - basis @ basis[i]) / np.sqrt(left[i])
        basis = np.column_stack([basis, column])
        left = np.maximum(left - column ** 2, 0.0)
        left[i] = 0.0
        chosen.append(i)
    return x[chosen]


def _least_norm(gram: np.ndarray, rounds: int = 20_000, tol: float = 1e-10) -> np.ndarray:
    """Convex weights of the points with products ``gram`` whose mix has the least norm, by pairwise steps."""
    c = np.zeros(len(gram))
    c[int(gram.diagonal().argmin())] = 1.0
    for _ in range(rounds):
        slope = gram @ c
        to, frm = int(slope.argmin()), int(np.where(c > 0, slope, -np.inf).argmax())
        fall = slope[frm] - slope[to]
        if fall <= tol * max(c @ slope, 1e-300):
            break
        bend = gram[to, to] + gram[frm, frm] - 2.0 * gram[to, frm]
        step = c[frm] if bend <= 0 else min(c[frm], fall / bend)
        c[to] += step
        c[frm] = c[frm] - step if step < c[frm] else 0.0
    return c


def _lowest_mean(data: DataFrame, model: Boundary, lower: np.ndarray) -> np.ndarray:
    """Mean lifted vector of the ``nu`` share of rows that score lowest, summed per task first. ``lower`` is the sum and number of
    the rows that score lower than any of ``data``.

    Rows at the boundary share what the rows below it leave of the share, so no row weighs more than the dual allows.
    """
    dims = len(model.weights)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, dims + 1))
        for pdf in batches:
            found = [], []
            for z, raw in model.lifted(_matrix(pdf)):
                raw = np.round(raw, DIGITS)
                found[0].append(z[raw < model.rho])
                found[1].append(z[raw == model.rho])
            for i, parts in enumerate(found):
                part = np.concatenate(parts)
                total[i] += np.append(part.sum(axis=0), len(part))
        yield pd.DataFrame({"j": np.arange(2 * dims + 2), "v": total.ravel()})

    sums = data.mapInPandas(partial, "j int, v double").groupBy("j").agg(F.sum("v").alias("v")).collect()
    below, at = np.array([r["v"] for r in sorted(sums, key=lambda r: r["j"])]).reshape(2, dims + 1)
    below = below + lower
    part = min(1.0, max(0.0, (model.nu * model.n - below[-1]) / at[-1])) if at[-1] else 0.0
    mixed = below + part * at
    return mixed[:-1] / mixed[-1]


def _quantile(data: DataFrame, model: Boundary, share: float) -> float:
    scored = with_raw_score(data, model)
    return float(scored.agg(F.percentile_approx("raw", share, 10000).alias("q")).first()["q"])


def with_raw_score(data: DataFrame, model: Boundary) -> DataFrame:
    @F.pandas_udf("double")
    def raw(*cols: pd.Series) -> pd.Series:
        return pd.Series(np.round(model.raw(np.column_stack(cols)), DIGITS))

    return data.withColumn("raw", raw(*FEATURES))


def score(feats: DataFrame, model: Boundary) -> DataFrame:
    """Decision value, flag, normalised score, confidence and reasons per sheet."""
    @F.pandas_udf("double")
    def decide(*cols: pd.Series) -> pd.Series:
        return pd.Series(model.decision(np.column_stack(cols)))

    s = feats.withColumn("score", decide(*FEATURES)).withColumn("is_anomaly", F.col("score") < 0)
    return s.select(
        *feats.columns, "score", "is_anomaly", score_normalized(F.col("score")).alias("score_normalized"),
        score_confidence(F.col("score")).alias("confidence"),
        explanation({c: F.col(c) for c in FEATURES}, F.col("is_anomaly"), F.col("score")).alias("explanation"))


def fit_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("n_samples"), F.count_if("is_anomaly").alias("n_anomalies"),
        F.round(F.count_if("is_anomaly") * 100.0 / F.count("*"), 1).alias("pct_anomalies"))


def bulk_report(scored: DataFrame) -> DataFrame:
    """Anomalous sheets, lowest score first, next to the number analysed. They are written before they are sorted, since
    finding the bounds of a sort would score every sheet once more."""
    n = scored.agg(F.count("*")).scalar()
    found = cut_lineage(scored.where("is_anomaly").select(
        "sheet_id", "station", "contest_id", "score", "confidence", F.array_join("explanation", " | ").alias("explanation")))
    return found.withColumn("analysed", n).orderBy("score", "sheet_id")


_ARRAYS = ("mean", "scale", "weights", "directions", "offsets", "landmarks")
_NUMBERS = ("rho", "nu", "n", "gamma", "gap")


def save_model(spark: SparkSession, model: Boundary, path: str) -> None:
    """Weights and parameters as one small parquet table."""
    rows = [(name, [float(x) for x in np.ravel(getattr(model, name))]) for name in _ARRAYS + _NUMBERS if hasattr(model, name)]
    spark.createDataFrame(rows, "name STRING, v ARRAY<DOUBLE>").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Boundary:
    parts = {r["name"]: np.array(r["v"]) for r in spark.read.parquet(path).collect()}
    parts |= {name: float(parts[name][0]) for name in _NUMBERS if name in parts}
    parts["n"] = int(parts["n"])
    if "landmarks" in parts:
        parts["landmarks"] = parts["landmarks"].reshape(-1, len(FEATURES))
        return LandmarkModel(**parts)
    parts["directions"] = parts["directions"].reshape(len(FEATURES), -1)
    return OneClassModel(**parts)
