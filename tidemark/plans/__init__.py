"""The queries of the market operators, registered on import."""

from . import backtests, cleaning, evaluation, forecasts, indicators, options, panels, ranges, relate, rotation, scoring, selection, snapshot, stores, trading, volatility  # noqa: F401
