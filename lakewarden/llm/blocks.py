"""Arrow batches as bytes, and names for columns of our own."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: A-Z to a-z, everything else as it is.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes | None]:
    """UTF-8 of every text of a column, null as None, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py()


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores in front until no column has it, upper or lower case."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found
