"""Every query of the library, by operator name, and the SQL that gives the same rows where SQL can."""

from fieldmerge.plans import flows, history, matching, quality, reports, schema  # noqa: F401
from fieldmerge.plans.register import ORACLES, QUERIES  # noqa: F401
