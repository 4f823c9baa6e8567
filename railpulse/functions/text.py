"""Text columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space around a bank spelling.
WHITE_SPACE = " \t\n\r\x0b\x0c"


def stripped(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def looked_up(key: Column, mapping: dict[str, str]) -> Column:
    """The value of ``key`` in a small fixed mapping, or NULL."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(literal, key)
