"""All registered queries; importing a module registers its queries."""

from latewing.plans import flights, scores, files, learning, streams, trajectories  # noqa: F401
from latewing.plans.registry import QUERIES  # noqa: F401
