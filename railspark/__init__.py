"""railspark: rail-operations analytics as Spark DataFrame operators.

Every operator is a pure function ``DataFrame -> DataFrame`` (scalar helpers
take and return ``Column``).  The work runs on executors through built-in
Spark expressions; iterative graph operators loop over DataFrame joins and
cut lineage with ``checkpoint()`` in the session's checkpoint directory.
"""

from railspark.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
