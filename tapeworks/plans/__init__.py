"""Importing the package registers all queries."""

from . import accounts, bars, controllers, event_time, events, ledger, live, market, panels, patterns, scores, store, whole  # noqa: F401
