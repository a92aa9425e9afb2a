"""Operators for large-scale training-data preparation.

Every module here is self-contained: nothing outside this subpackage imports
it.  ``queries()`` and ``oracle_sql()`` collect the registered ``opN_<name>``
queries and, where SQL can state them, their DuckDB counterparts.
"""

from __future__ import annotations


def queries():
    from lithoframe.llm import registry

    return registry.queries()


def oracle_sql():
    from lithoframe.llm import registry

    return registry.oracle_sql()
