"""One large memory per worker process.

Spark reuses Python workers for operator after operator.  What an operator remembers between batches (pieces,
words, a vocabulary) is held here under its name, and goes when another operator asks for its own.
"""

from __future__ import annotations

import gc
from collections.abc import Callable
from typing import Any

_HELD: dict[tuple, Any] = {}


def held(name: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gave for ``name``, as long as no other name was asked for since."""
    if name not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[name] = make()
    return _HELD[name]
