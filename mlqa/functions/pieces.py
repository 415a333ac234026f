"""Arrow batches in pieces of bounded size.

Python values take several times the bytes of the Arrow buffers that they come from, so a
task turns one piece at a time into Python values, never a whole batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

PIECE_BYTES = 1 << 20


def pieces(*columns: pa.Array) -> Iterator[list[pa.Array]]:
    """Runs of rows of the columns, of about ``PIECE_BYTES`` by the mean row (at least one
    run, at least a row each)."""
    n = len(columns[0])
    step = max(1, n * PIECE_BYTES // max(1, sum(c.nbytes for c in columns)))
    for at in range(0, max(n, 1), step):
        yield [c.slice(at, step) for c in columns]


def by_piece(f: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """``f`` of the columns, one piece after the other."""
    return pa.concat_arrays([f(*some) for some in pieces(*columns)])
