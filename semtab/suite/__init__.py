"""Every operator as a query over the test tables, with the same query in SQL."""

from semtab.suite import by_meaning, by_value, jobs, search  # noqa: F401
from semtab.suite.registry import ORACLES, QUERIES  # noqa: F401
