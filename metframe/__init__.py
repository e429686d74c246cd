"""metframe: meteorological bulletins as Spark DataFrames.

Bulletin text -> sentences -> mentions -> entities -> flat and star tables, plus the
pair-filter queries, grouped views, facets, exports and updates over them.
"""

from metframe.functions.pairs import FilterPair
from metframe.session import build_session

__all__ = ["FilterPair", "build_session"]
