"""Every registered query with its SQL, gathered from the modules of this folder."""

from __future__ import annotations

from freshet.plans import base, basins, events_and_networks, fits, more, outliers, places, rivers, samples_and_models, training  # noqa: F401  registration

QUERIES = base.QUERIES
ORACLE = base.ORACLE
