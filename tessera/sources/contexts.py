"""JSON-LD contexts by name, fetched when they are first met and kept by each worker."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Mapping

from tessera.sources.http import Executor, Request, executor_from, follow_redirects

CAPACITY = 100
_LOADED: OrderedDict[str, str] = OrderedDict()


def clear() -> None:
    """Forget every document of this process."""
    _LOADED.clear()


class RemoteContexts(Mapping):
    """IRI to the text of the document there. The ``capacity`` documents used last are kept in a
    process; ``given`` has documents that are never fetched."""

    def __init__(self, options: Mapping[str, str] | None = None, capacity: int = CAPACITY, given: Mapping[str, str] | None = None, execute: Executor | None = None):
        self.options, self.capacity, self.given, self.execute = dict(options or {}), capacity, dict(given or {}), execute

    def __contains__(self, name: object) -> bool:
        return name in self.given or isinstance(name, str) and name.startswith(("http://", "https://"))

    def __getitem__(self, name: str) -> str:
        if name in self.given:
            return self.given[name]
        if name not in _LOADED:
            got = follow_redirects(self.execute or executor_from(self.options), Request(name, headers={"Accept": "application/ld+json, application/json"}))
            if got.status != 200:
                raise ValueError(f"context {name} answered {got.status}")
            _LOADED[name] = got.body.decode()
        _LOADED.move_to_end(name)
        while len(_LOADED) > max(1, self.capacity):
            _LOADED.popitem(last=False)
        return _LOADED[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.given)

    def __len__(self) -> int:
        return len(self.given)
