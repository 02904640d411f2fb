"""All registered queries: importing the plan modules fills the registry."""

from crashgrid.plans.registry import ORACLES, QUERIES  # noqa: F401
from crashgrid.plans import incident_queries  # noqa: F401,E402
from crashgrid.plans import text_queries  # noqa: F401,E402
from crashgrid.plans import source_queries  # noqa: F401,E402
from crashgrid.plans import profile_queries  # noqa: F401,E402
from crashgrid.plans import graph_queries  # noqa: F401,E402
from crashgrid.plans import model_queries  # noqa: F401,E402
from crashgrid.plans import stream_queries  # noqa: F401,E402
