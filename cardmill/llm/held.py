"""One large object per worker process: a worker that turns to another operator's object lets the last one go."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from typing import Any

_HELD: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object of this key, made when first asked for; whatever was held for another key goes before."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]
