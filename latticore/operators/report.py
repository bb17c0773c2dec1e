"""Reports: profile data for plots, a methods paragraph, confidence intervals and a reporting checklist."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from latticore.functions.special import normal_quantile
from latticore.operators import mixture as M


def profile_data(fit: M.Fit, spark: SparkSession) -> DataFrame:
    """class, item, value: probabilities and means, continuous items as z-scores against the model's overall mean and variance."""
    rows = []
    for e, p in zip(fit.spec.emissions(), fit.params):
        for j, c in enumerate(e.items):
            if "mean" in p:
                mu = float(fit.pi @ p["mean"][:, j])
                sd = float(np.sqrt(fit.pi @ (p["var"][:, j] + (p["mean"][:, j] - mu) ** 2)))
                rows += [(k + 1, c, (float(p["mean"][k, j]) - mu) / sd) for k in range(fit.spec.k)]
            elif "rate" in p:
                rows += [(k + 1, c, float(p["rate"][k, j])) for k in range(fit.spec.k)]
            elif p["p"].ndim == 2:
                rows += [(k + 1, c, float(p["p"][k, j])) for k in range(fit.spec.k)]
            else:  # the expected category
                rows += [(k + 1, c, float(p["p"][k, j] @ np.arange(1, p["p"].shape[2] + 1))) for k in range(fit.spec.k)]
    return spark.createDataFrame(rows, "class int, item string, value double")


def confint(fit: M.Fit, x: np.ndarray, w: np.ndarray, level: float = 0.95, kind: str = "robust") -> pd.DataFrame:
    """The measurement estimates with their intervals, held in the range of probabilities and variances."""
    t = fit.measurement_estimates(x, w, kind)
    z = normal_quantile(0.5 + level / 2)
    low, high = t["estimate"] - z * t["se"], t["estimate"] + z * t["se"]
    bounded = t["parameter"].isin(["p", "probability", "zero"])
    return t.assign(lower=np.where(bounded | t["parameter"].isin(["var", "rate"]), np.maximum(low, 0), low), upper=np.where(bounded, np.minimum(high, 1), high))


FAMILY = {"binary": "binary", "categorical": "categorical", "ordinal": "ordinal", "continuous": "continuous", "count": "count", "zip": "zero-inflated count", "negbin": "overdispersed count"}


def report_methods(fit: M.Fit) -> str:
    """A paragraph that says what was fitted and how."""
    kinds = [f"{len(cols)} {FAMILY[f.partition(':')[0]]} indicator{'s' if len(cols) != 1 else ''}" for f, cols in fit.spec.blocks]
    m = fit.metrics()
    parts = [
        f"A mixture model with {fit.spec.k} class{'es' if fit.spec.k != 1 else ''} was fitted to {' and '.join(kinds)} of {fit.n:,.0f} cases.",
        "Parameters were estimated by expectation-maximisation at the posterior mode; cases with missing indicators were kept, assuming that they are missing at random.",
        f"Of {max(1, len(fit.logliks))} random starts, {fit.replicated} reached the best log-likelihood ({fit.loglik:.2f}, {fit.n_params} parameters).",
        f"BIC was {m['bic']:.1f}, AIC {m['aic']:.1f}, and the relative entropy {m['relative_entropy']:.3f}.",
    ]
    if not fit.converged:
        parts.append("The estimation did not converge.")
    return " ".join(parts)


def checklist(fit: M.Fit, spark: SparkSession) -> DataFrame:
    """item, question, status, answer: what a report of the model should state, as far as the fit knows it."""
    m = fit.metrics()
    rows = [
        ("Which indicators and families were used?", "reported", ", ".join(f"{f}: {' '.join(c)}" for f, c in fit.spec.blocks)),
        ("How were missing data handled?", "reported", "full information, missing at random"),
        ("How many random starts were used?", "reported", str(max(1, len(fit.logliks)))),
        ("Was the best solution replicated?", "reported" if fit.replicated > 1 else "check", str(fit.replicated)),
        ("Did the estimation converge?", "reported" if fit.converged else "check", str(fit.converged)),
        ("How many cases were analysed?", "reported", f"{fit.n:.0f}"),
        ("Which fit indices are given?", "reported", ", ".join(k for k in m if k not in ("loglik", "n_params", "replicated"))),
        ("What is the relative entropy?", "reported", f"{m['relative_entropy']:.3f}"),
        ("How large are the classes?", "reported", ", ".join(f"{v:.3f}" for v in fit.pi)),
        ("Are the classes' profiles shown?", "author", ""),
        ("Why was the number of classes chosen?", "author", ""),
    ]
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "item int, question string, status string, answer string")
