"""All registered queries (imports fill ``REGISTRY``)."""

from mlqa.catalog.base import REGISTRY  # noqa: F401
from mlqa.catalog import judging  # noqa: F401
from mlqa.catalog import corpus  # noqa: F401
from mlqa.catalog import completions  # noqa: F401
from mlqa.catalog import language  # noqa: F401
from mlqa.catalog import io_queries  # noqa: F401
