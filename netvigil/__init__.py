"""netvigil: network-flow anomaly analytics as Spark DataFrame jobs.

Every public operator takes DataFrames (and Columns) and returns a
DataFrame or Column; the work is planned by Catalyst and runs on the
executors.  Only counts, column names and small fixed lookups ever
reach the driver.
"""

from netvigil.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
