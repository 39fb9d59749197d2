"""propcube: listing and market analytics on Spark.

Every operator is a plain function ``DataFrame(s) -> DataFrame`` built from
Spark SQL built-ins, so Catalyst sees one declarative plan per query.
"""

from propcube.session import get_session, storage_root

__all__ = ["get_session", "storage_root"]
