"""All queries of this subpackage."""

from crashgrid.llm.registry import ORACLES, QUERIES  # noqa: F401
from crashgrid.llm import exact_dedup  # noqa: F401,E402
from crashgrid.llm import sharding  # noqa: F401,E402
from crashgrid.llm import warc  # noqa: F401,E402
from crashgrid.llm import topk  # noqa: F401,E402
from crashgrid.llm import bpe  # noqa: F401,E402
from crashgrid.llm import pii  # noqa: F401,E402
from crashgrid.llm import toxicity  # noqa: F401,E402
from crashgrid.llm import minhash  # noqa: F401,E402
from crashgrid.llm import mixing  # noqa: F401,E402
from crashgrid.llm import suffix_dedup  # noqa: F401,E402
from crashgrid.llm import conversations  # noqa: F401,E402
from crashgrid.llm import alignment  # noqa: F401,E402
from crashgrid.llm import quality  # noqa: F401,E402
