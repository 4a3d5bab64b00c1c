"""Regime-change data: families of noisy copies of hidden signals, lone signals and noise, with a change at one row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.tables import frame_of

# The families' names and those of their first features, and the names of the lone signals.
FAMILIES = {
    "momentum": "momentum_5d momentum_10d momentum_21d momentum_63d momentum_126d momentum_252d",
    "volatility": "vol_realized_10d vol_realized_21d vol_implied_30d vol_parkinson_21d vol_garman_klass_21d vol_implied_60d",
    "value": "value_pe value_pb value_ev_ebitda value_fcf_yield value_div_yield value_earnings_yield",
    "liquidity": "volume_adv_20d volume_turnover_21d volume_amihud_21d volume_rel_5d volume_dollar_63d volume_obv_slope",
    "quality": "quality_roe quality_roa quality_gross_margin quality_accruals quality_leverage quality_eps_stability",
    "sentiment": "sentiment_news_1d sentiment_news_5d sentiment_social_1d sentiment_revisions sentiment_short_int sentiment_put_call",
    "carry": "carry_fx_3m carry_rates_1y carry_roll_yield carry_basis_3m carry_div_futures carry_term_slope",
    "size": "size_log_mcap size_log_ev size_log_sales size_log_assets size_log_float size_log_employees",
    "macro": "macro_curve_2s10s macro_credit_spread macro_breakeven_5y macro_pmi_surprise macro_usd_index macro_oil_mom",
    "reversal": "reversal_1d reversal_5d reversal_intraday reversal_overnight reversal_week reversal_gap",
}
LONE = "earnings_surprise beta_252d skew_realized_63d rsi_14d macd_signal bollinger_width_20d idio_vol_63d max_return_21d insider_buy_ratio seasonality_month high_low_range_5d dist_52w_high analyst_dispersion options_iv_skew etf_flow_5d".split()


@dataclass(frozen=True)
class Regime:
    """What the data are made of; checked when made.

    Signals are standard normal. From row ``regime_change_at`` on each becomes s (1 + magnitude / 4) +- magnitude, and a
    share ``regime_concept_shift`` of the coefficients in use changes sign. A family shows its signal with noise whose
    sizes are spread over ``group_noise_range``; lone signals show as they are. The target is linear in the signals,
    with noise of ``target_noise`` times the signals' part.
    """

    n_samples: int = 10_000
    n_informative: int = 10
    n_correlated_groups: int = 3
    features_per_group: int = 5
    n_noise: int = 10
    regime_change_at: int | None = None
    regime_shift_magnitude: float = 2.0
    target_noise: float = 0.1
    random_state: int | None = 42
    n_informative_groups: int | None = None
    group_noise_range: tuple[float, float] = (0.2, 0.8)
    regime_concept_shift: float = 0.0

    def __post_init__(self) -> None:
        low, high = self.group_noise_range
        wrong = {
            "n_samples must be 1 or more": self.n_samples < 1,
            "numbers of features must not be negative": min(self.n_informative, self.n_correlated_groups, self.n_noise) < 0,
            "a group needs a feature": bool(self.n_correlated_groups) and self.features_per_group < 1,
            "the change must come after the first and before the last row": self.regime_change_at is not None and not 0 < self.regime_change_at < self.n_samples,
            "target_noise must not be negative": self.target_noise < 0,
            "n_informative_groups must be at most n_correlated_groups": not 0 <= self.used <= self.n_correlated_groups,
            "group_noise_range must be 0 <= low <= high": not 0 <= low <= high,
            "regime_concept_shift must lie in [0, 1]": not 0 <= self.regime_concept_shift <= 1,
            "a concept shift needs a change of regime": bool(self.regime_concept_shift) and self.regime_change_at is None,
        }
        if any(wrong.values()):
            raise ValueError(next(text for text, bad in wrong.items() if bad))

    @property
    def used(self) -> int:
        return self.n_correlated_groups if self.n_informative_groups is None else self.n_informative_groups

    def families(self) -> dict[str, list[str]]:
        known = list(FAMILIES.items())
        out = {}
        for g in range(self.n_correlated_groups):
            name, features = known[g] if g < len(known) else (f"factor{g}", "")
            first = features.split()[: self.features_per_group]
            out[name] = first + [f"{name}_{k}" for k in range(len(first), self.features_per_group)]
        return out

    def lone(self) -> list[str]:
        return [LONE[i] if i < len(LONE) else f"alpha_signal_{i}" for i in range(self.n_informative)]

    def noise(self) -> list[str]:
        return [f"noise_{i:02d}" for i in range(self.n_noise)]

    def signals(self) -> list[str]:
        return [*self.families(), *self.lone()]

    def columns(self) -> list[str]:
        return [f for names in self.families().values() for f in names] + self.lone() + self.noise()

    @property
    def scale(self) -> float:
        return 1.0 + self.regime_shift_magnitude / 4.0

    def levels(self) -> np.ndarray:
        low, high = self.group_noise_range
        return np.linspace(low, high, self.features_per_group) if self.features_per_group > 1 else np.array([low])

    def coefficients(self, rng: np.random.Generator) -> np.ndarray:
        parts = []
        for n, low, high in ((self.n_correlated_groups, 0.5, 1.5), (self.n_informative, 0.2, 1.0)):
            size = rng.uniform(low, high, n)
            parts.append(size * rng.choice([-1.0, 1.0], n))
        parts[0][self.used :] = 0.0
        return np.concatenate(parts)

    def flipped(self, coef: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Numbers of the coefficients that change sign; drawn after everything else, so that it alters nothing else."""
        active = np.flatnonzero(coef)
        n = int(round(self.regime_concept_shift * len(active))) if self.regime_concept_shift else 0
        return np.sort(rng.choice(active, size=n, replace=False)) if n else np.empty(0, int)

    def about(self, direction: np.ndarray | None, noise_levels: dict[str, float], coef: np.ndarray, flipped: np.ndarray, noise_std: float) -> dict:
        """What the data were made with."""
        names, families = self.signals(), self.families()
        after = np.where(np.isin(np.arange(len(coef)), flipped), -coef, coef)
        of = {f: g for g, members in families.items() for f in members} | dict.fromkeys([*self.lone(), *self.noise()])
        informative = [g for g, c in zip(families, coef) if c]
        moved = direction is not None
        return {
            "groups": families, "informative_groups": informative, "uninformative_groups": [g for g in families if g not in informative], "informative_features": self.lone(), "noise_features": self.noise(),
            "coefficients": dict(zip(names, coef.tolist())), "coefficients_after_regime": dict(zip(names, after.tolist())), "flipped_signals": [names[i] for i in flipped], "feature_noise_levels": noise_levels, "feature_to_group": of,
            "shifted_features": [f for f in self.columns() if f not in set(self.noise())] if moved else [], "regime_change_at": self.regime_change_at,
            "regime_shift": {n: {"mean_shift": float(self.regime_shift_magnitude * d), "scale": self.scale} for n, d in zip(names, direction)} if moved else None,
            "target_noise_std": noise_std, "random_state": self.random_state}


def regime_arrays(**options) -> tuple[np.ndarray, np.ndarray, list[str], dict]:
    """X, y, feature names and a description; the same numbers for the same options (see Regime)."""
    r = Regime(**options)
    rng, n, k = np.random.default_rng(r.random_state), r.n_samples, r.n_correlated_groups + r.n_informative
    s = rng.standard_normal((n, k))
    direction = None
    if r.regime_change_at is not None and k:
        direction = rng.choice([-1.0, 1.0], size=k)
        s[r.regime_change_at :] = s[r.regime_change_at :] * r.scale + r.regime_shift_magnitude * direction
    x, levels = np.empty((n, len(r.columns()))), {}
    at = 0
    for g, members in enumerate(r.families().values()):
        for f, sigma in zip(members, rng.permutation(r.levels())):
            x[:, at] = s[:, g] + sigma * rng.standard_normal(n)
            levels[f] = float(sigma)
            at += 1
    x[:, at : at + r.n_informative] = s[:, r.n_correlated_groups :]
    for j in range(at + r.n_informative, x.shape[1]):
        x[:, j] = rng.standard_normal(n)
    coef = r.coefficients(rng)
    std = float(r.target_noise * np.sqrt(np.sum(coef**2)))
    error = std * rng.standard_normal(n)
    flipped = r.flipped(coef, rng)
    y = s @ coef
    if len(flipped):
        y[r.regime_change_at :] = s[r.regime_change_at :] @ np.where(np.isin(np.arange(k), flipped), -coef, coef)
    return x, y + error, r.columns(), r.about(direction, levels, coef, flipped, std)


def regime_data(spark: SparkSession, **options) -> tuple[DataFrame, list[str], dict]:
    """The same as a DataFrame with row_id, the features and target; the rows are made on the driver."""
    x, y, names, about = regime_arrays(**options)
    frame = pd.DataFrame(x, columns=names)
    frame.insert(0, "row_id", np.arange(len(x)))
    frame["target"] = y
    return frame_of(spark, frame), names, about


def regime_frame(spark: SparkSession, partitions: int | None = None, **options) -> tuple[DataFrame, list[str], dict]:
    """Data of the same make for any number of rows, made where they are needed: not the same numbers, the same law."""
    r = Regime(**options)
    rng, names = np.random.default_rng(r.random_state), r.signals()
    seed = int(rng.integers(1 << 40))
    direction = rng.choice([-1.0, 1.0], size=len(names)) if r.regime_change_at is not None and names else None
    rows = (spark.range(r.n_samples) if partitions is None else spark.range(0, r.n_samples, 1, partitions)).withColumnRenamed("id", "row_id")
    late = F.col("row_id") >= F.lit(r.regime_change_at) if direction is not None else F.lit(False)
    hidden = []
    for i in range(len(names)):
        z = F.randn(seed + i)
        hidden.append(z.alias(f"_s{i}"))
    rows = rows.select("row_id", *hidden)
    if direction is not None:
        rows = rows.select("row_id", *[F.when(late, F.col(f"_s{i}") * r.scale + float(r.regime_shift_magnitude * d)).otherwise(F.col(f"_s{i}")).alias(f"_s{i}") for i, d in enumerate(direction)])
    levels, columns, draw = {}, [], seed + len(names)
    for g, members in enumerate(r.families().values()):
        for f, sigma in zip(members, rng.permutation(r.levels())):
            draw += 1
            columns.append((F.col(f"_s{g}") + float(sigma) * F.randn(draw)).alias(f))
            levels[f] = float(sigma)
    columns += [F.col(f"_s{r.n_correlated_groups + i}").alias(f) for i, f in enumerate(r.lone())]
    columns += [F.randn(draw + 1 + i).alias(f) for i, f in enumerate(r.noise())]
    coef = r.coefficients(rng)
    std = float(r.target_noise * np.sqrt(np.sum(coef**2)))
    flipped = set(r.flipped(coef, rng).tolist())
    target = F.lit(0.0)
    for i, c in enumerate(coef.tolist()):
        target = target + (F.when(late, -c).otherwise(c) if i in flipped else F.lit(c)) * F.col(f"_s{i}")
    out = rows.select("row_id", *columns, (target + std * F.randn(seed - 1)).alias("target"))
    return out, r.columns(), r.about(direction, levels, coef, np.array(sorted(flipped), dtype=int), std)
