"""Scalar column functions (``Column -> Column``), all built-in expressions."""

from railspark.functions.scalar import *  # noqa: F401,F403
from railspark.functions.geo import *  # noqa: F401,F403
