"""skarn: dictionary, pattern, posting-list and row-stream analytics on PySpark."""

from skarn.session import get_session, table

__all__ = ["get_session", "table"]
