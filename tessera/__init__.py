"""tessera — retail / customer-experience analytics as Spark DataFrame jobs.

Every public operator takes and returns DataFrames (or Columns) and is built
only from Spark's DataFrame, SQL, ML and Structured Streaming APIs.
"""

from tessera.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
