"""All registered queries; importing this package fills the catalog."""

from . import columns, domain, features, models, profile, quality, sources, splits, streams  # noqa: F401
from .catalog import ORACLES, QUERIES  # noqa: F401
