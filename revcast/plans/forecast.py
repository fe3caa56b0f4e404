"""A forecast run: daily series -> backtested models -> ranking -> blend -> display forecast."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.operators import baselines, blend, evaluate, linear, postprocess, regressive, smoothing, stepping, trees
from revcast.operators.align import effective_frequency
from revcast.operators.features import recipe
from revcast.plans.store import PredictionStore, fingerprint
from revcast.session import checkpoint_dir, cut

BASELINE_SET = set(baselines.BASELINES)

# A model of the user's: (training rows, folds, horizon, frequency) -> forecast rows.
FitPredict = Callable[[DataFrame, list[int], int, str], DataFrame]

PER_SERIES: dict[str, Callable] = {
    "decomposition": baselines.decomposition_forecast,
    "exponential_smoothing": smoothing.exponential_smoothing,
    "theta": smoothing.theta,
    "autoregression": regressive.autoregression,
    "trend_fourier": regressive.trend_fourier,
}
CLOSED_FORM = [*baselines.BASELINES, "decomposition"]
ALL_MODELS = [*baselines.BASELINES, *PER_SERIES, *linear.MODELS, *trees.FULL]


PREDICTION = "model string, fold int, series_id string, step int, ds date, yhat double, yhat_lower double, yhat_upper double"


@dataclass
class ForecastConfig:
    """``mode`` shapes ``ForecastRun.output``; ``future`` (series_id, ds, helpers or flags) is what is known of coming days.

    ``store`` is a folder on shared storage: a run that is started again with the same data and settings reads what is
    there and works out the rest.
    """

    horizon: int | str = 30  # periods, or a span such as "90D" or "12M"
    frequency: str = "D"
    models: Sequence[str] = tuple(CLOSED_FORM)
    depth: str = "balanced"
    preference: str = "balanced"
    mode: str = "scenario"
    detect_frequency: bool = False
    lag_profile: str | None = None
    future: DataFrame | None = None
    store: str | None = None
    tree_settings: dict[str, trees.TreeSettings] = field(default_factory=lambda: dict(trees.FULL))
    custom: dict[str, FitPredict] = field(default_factory=dict)


@dataclass
class ForecastRun:
    """Tables of a run; the daily series and the predictions of every model are stored, so plans stay short.

    ``skipped`` has a row (model, series_id, reason) for every chosen model that gave a series no usable forecast;
    ``errors`` names models that failed, with the fold where only that one did.
    """

    daily: DataFrame
    folds: DataFrame
    predictions: DataFrame
    gate: DataFrame
    fold_metrics: DataFrame
    ranking: DataFrame
    best: DataFrame
    blended: DataFrame
    choice: DataFrame
    display: DataFrame
    output: DataFrame
    skipped: DataFrame
    errors: list[tuple[str, str]]
    fitted: dict[str, object]


Unit = tuple[list[str], list[int], Callable[[], "DataFrame | None"]]


def units_of(train: DataFrame, missing: dict[str, list[int]], cfg: ForecastConfig, fitted: dict[str, object]) -> list[Unit]:
    """What is to be worked out by itself: (models, folds, job).

    The baselines are one job, as are all folds of a model that does them in one plan; of a tree model every fold is one.
    """
    out: list[Unit] = []
    base = [m for m in missing if m in BASELINE_SET]
    if base:
        folds = sorted({f for m in base for f in missing[m]})
        out.append((base, folds, lambda: baselines.baseline_forecasts(train, cfg.horizon, cfg.frequency, base)))
    for name, folds in missing.items():
        some = train.where(F.col("fold").isin(*folds))
        if name in BASELINE_SET:
            continue
        if name in cfg.custom:
            out.append(([name], folds, partial(cfg.custom[name], some, folds, cfg.horizon, cfg.frequency)))
        elif name in PER_SERIES:
            known = {"future": cfg.future} if name == "trend_fourier" else {}
            # the whole table: a calendar of flags reaches beyond a fold
            out.append(([name], folds, partial(PER_SERIES[name], train if known else some, cfg.horizon, cfg.frequency, **known)))
        elif name in linear.MODELS:
            out.append(([name], folds, partial(linear.linear_forecast, train, folds, cfg.horizon, cfg.frequency, name, cfg.future, cfg.lag_profile)))
        elif name in trees.FULL:
            settings = cfg.tree_settings.get(name) or trees.FULL[name]
            rows = cut(stepping.model_rows(some, recipe(name, cfg.frequency, cfg.lag_profile)))

            def fit(fold: int, name=name, settings=settings, rows=rows) -> DataFrame | None:
                part, model = trees.tree_forecast(train, [fold], cfg.horizon, cfg.frequency, name, settings, cfg.future, cfg.lag_profile, rows)
                if fold == 0:
                    fitted[name] = model
                return part

            out += [([name], [fold], partial(fit, fold)) for fold in folds]
        else:
            raise ValueError(f"unknown model {name}")
    return out


def predict_models(daily: DataFrame, train: DataFrame, fold_ids: list[int], cfg: ForecastConfig) -> tuple[DataFrame, list[tuple[str, str]], dict[str, object]]:
    """Predictions of every chosen model and fold, each written to the store as soon as it is there.

    A model that fails, now or when it runs, is reported and left out; of a tree model only the fold that fails.  What the
    store has committed for the same data and settings is not worked out again.
    """
    spark = daily.sparkSession
    root = cfg.store or f"{checkpoint_dir(spark).rstrip('/')}/forecast-{uuid.uuid4().hex}"
    store, errors, fitted = PredictionStore(spark, root), [], {}
    chosen = list(dict.fromkeys([*[m.lower() for m in cfg.models], *cfg.custom]))
    known = [m for m in chosen if m in BASELINE_SET or m in PER_SERIES or m in linear.MODELS or m in trees.FULL or m in cfg.custom]
    errors += [(m, f"unknown model {m}") for m in chosen if m not in known]
    reusable = [m for m in known if m not in cfg.custom]
    ahead = fingerprint(cfg.future) if cfg.future is not None else None
    data = fingerprint(daily)

    def key(model: str) -> str:
        size = cfg.tree_settings.get(model) if model in trees.FULL else None
        return f"{data}|{ahead}|{cfg.horizon}|{cfg.frequency}|{cfg.depth}|{cfg.lag_profile}|{size}"

    def cells() -> dict[tuple[str, int], str]:
        seen = {k: store.committed(k) for k in {key(m) for m in reusable}}
        return {(m, f): p for m in reusable for (n, f), p in seen.get(key(m), {}).items() if n == m and f in fold_ids}

    there = cells()
    missing = {m: [f for f in fold_ids if (m, f) not in there] for m in known}
    units = units_of(train, {m: folds for m, folds in missing.items() if folds}, cfg, fitted)

    def work(unit: Unit) -> dict[tuple[str, int], str]:
        models, folds, job = unit
        try:
            part = job()
            if part is None:
                raise LookupError("not enough history")
            return store.put(key(models[0]), models, folds, part)
        except Exception as failed:  # noqa: BLE001 - one model must not stop the others
            alone = f"fold {folds[0]}: " if len(folds) == 1 and models[0] in trees.FULL else ""
            errors.extend((m, f"{alone}{failed.args[0] if isinstance(failed, LookupError) else failed}") for m in models)
            return {}

    with ThreadPoolExecutor(trees.FITS_AT_ONCE) as pool:
        for done in pool.map(work, units):
            there |= done
    if not there:
        raise ValueError(f"no model produced a forecast: {errors}")
    return store.load(there, PREDICTION), sorted(errors, key=lambda e: chosen.index(e[0])), fitted


def backtest(daily: DataFrame, cfg: ForecastConfig) -> tuple[ForecastConfig, DataFrame, DataFrame, list[tuple[str, str]], dict[str, object]]:
    """(resolved settings, folds, predictions, errors, fitted models) of a stored daily table."""
    if cfg.detect_frequency:
        cfg = replace(cfg, frequency=effective_frequency(daily, cfg.frequency))
    if isinstance(cfg.horizon, str):
        cfg = replace(cfg, horizon=evaluate.horizon_periods(cfg.horizon, cfg.frequency))
    folds = cut(evaluate.with_final_fold(evaluate.make_folds(daily, cfg.horizon, cfg.frequency, cfg.depth), daily))
    fold_ids = sorted(r["fold"] for r in folds.select("fold").collect())
    train = evaluate.training_rows(daily, folds)
    return cfg, folds, *predict_models(daily, train, fold_ids, cfg)


def run_forecast(daily: DataFrame, cfg: ForecastConfig | None = None) -> ForecastRun:
    """``daily`` has one row per series and day (series_id, ds, y and optional leads, cost, flags)."""
    daily = cut(daily)
    cfg, folds, predictions, errors, fitted = backtest(daily, cfg or ForecastConfig())
    final = predictions.filter("fold = 0").drop("fold")
    gate = cut(blend.sanity_gate(final, daily))
    kept = blend.drop_rejected(final, gate)
    # a model is judged on the series it may be used for
    per_fold, summary = evaluate.backtest_metrics(daily, folds, blend.drop_rejected(predictions, gate))
    # a model without any fold still takes part, without errors to show
    known = kept.select("model").distinct().join(summary, "model", "left")
    ranking = cut(blend.rank_models(blend.score_models(known), cfg.preference))
    profile = postprocess.trend_profile(daily)
    best = postprocess.trend_guardrail(blend.best_forecast(ranking, kept), profile)
    blended = postprocess.trend_guardrail(blend.blend(ranking, kept), profile)
    choice = postprocess.display_choice(best, blended, daily, cfg.frequency)
    shown = postprocess.display_forecast(best, blended, choice)
    display = postprocess.apply_day_factors(shown, postprocess.day_factors(daily), cfg.frequency)
    skipped = skipped_series(daily, final, gate, [*[m.lower() for m in cfg.models], *cfg.custom])
    output = postprocess.output_mode(display, cfg.mode)
    return ForecastRun(daily, folds, predictions, gate, per_fold, ranking, best, blended, choice, display, output, skipped, errors, fitted)


def skipped_series(daily: DataFrame, final: DataFrame, gate: DataFrame, models: Sequence[str]) -> DataFrame:
    """(model, series_id, reason): series without a forecast of a chosen model, or with one that was rejected."""
    cells = daily.select("series_id").distinct().select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), "series_id")
    missing = cells.join(final.select("model", "series_id").distinct(), ["model", "series_id"], "left_anti")
    rejected = gate.filter("passed = 0").select("model", "series_id", "reason")
    return missing.withColumn("reason", F.lit("no forecast: the history is too short or the model failed")).unionByName(rejected)
