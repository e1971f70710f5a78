"""Resolvers: from a source to a local file. The first of a chain that takes a source has it.

The chain decides by the same rules as text.resolver does over columns. Those
that need a network are plugged in by `Chain(fetch={name: function})`.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

from .text import TRACK_URL


class ResolverError(RuntimeError):
    pass


class UnsupportedSource(ResolverError):
    pass


class PreviewUnavailable(ResolverError):
    pass


@dataclass
class Resolved:
    path: str
    origin: str
    title: str | None = None
    artist: str | None = None


Fetch = Callable[[str, str], Resolved]  # source, folder for its files


def local(source: str, _: str) -> Resolved:
    path = unquote(urlparse(source).path) if source.startswith("file://") else os.path.expanduser(source)
    if not os.path.isfile(path):
        raise ResolverError(f"no file at {path}")
    return Resolved(path, source)


# In order: name, and whether it takes a source.
TAKES: tuple[tuple[str, Callable[[str], bool]], ...] = (
    ("local", lambda s: s.startswith("file://") or "://" not in s),
    ("spotify", lambda s: re.match(TRACK_URL, s) is not None),
    ("ytdlp", lambda s: re.match("https?://", s) is not None),
)


@dataclass
class Chain:
    fetch: dict[str, Fetch] = field(default_factory=dict)

    def name(self, source: str) -> str:
        for name, takes in TAKES:
            if takes(source):
                return name
        raise UnsupportedSource(f"nothing takes {source}")

    @contextmanager
    def open(self, source: str) -> Iterator[Resolved]:
        """The file of a source while the block runs; what was fetched is removed after it."""
        name = self.name(source)
        run = {"local": local, **self.fetch}.get(name)
        if run is None:
            raise UnsupportedSource(f"{name} sources need a function that fetches them")
        folder = tempfile.mkdtemp(prefix="source-")
        try:
            yield run(source, folder)
        finally:
            shutil.rmtree(folder, ignore_errors=True)
