"""Summary builders by subject. Importing this package fills the registry."""

from tripweave.plans.summaries import (  # noqa: F401
    activity,
    escort,
    external_contracts,
    joint,
    location,
    lookup_stats,
    persons,
    tours,
    trips,
    validation,
    vehicles,
)
