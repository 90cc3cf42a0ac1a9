"""Connected components of links, each round written to the scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pointlake.llm.common import written
from pointlake.operators import components as shared


def components(links: DataFrame) -> DataFrame:
    """links (a, b), stored -> a stored table (node, component): the smallest node reachable, for every node that reaches
    a smaller one."""
    return shared.components(links, written)
