"""Query plans over the standard tables."""

from . import (  # noqa: F401
    layout_queries,
    provider_queries,
    state_queries,
    text_queries,
    translate_queries,
    unit_queries,
)
from .registry import QUERIES  # noqa: F401
