"""A test-time check that domain values come out of decoders only."""

from __future__ import annotations

import contextlib
import functools
import re
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from dataclasses import dataclass, field

_depth: ContextVar[int] = ContextVar("lodegrain_construction", default=0)
_enabled: ContextVar[bool] = ContextVar("lodegrain_guard", default=False)


class ConstructionGuardError(RuntimeError):
    """A guarded class was constructed outside of a decoder."""

    def __init__(self, name: str):
        super().__init__(f"{name} must be constructed by a decoder")
        self.name = name


@contextlib.contextmanager
def decoding() -> Iterator[None]:
    """The scope that decoders open; guarded classes may be constructed inside."""
    token = _depth.set(_depth.get() + 1)
    try:
        yield
    finally:
        _depth.reset(token)


@contextlib.contextmanager
def enforced() -> Iterator[None]:
    """Turn the guard on, as in tests; scopes may be nested."""
    token = _enabled.set(True)
    try:
        yield
    finally:
        _enabled.reset(token)


def is_active() -> bool:
    """Whether the guard is on."""
    return _enabled.get()


def run(f: Callable[[], object]) -> None:
    with enforced():
        f()


def call(f: Callable):
    """The result of f with the guard on."""
    with enforced():
        return f()


def check_active(name: str) -> None:
    if _enabled.get() and not _depth.get():
        raise ConstructionGuardError(name)


def decoder_method(f: Callable) -> Callable:
    """Mark a function of the caller's own as a decoder."""

    @functools.wraps(f)
    def inner(*a, **b):
        with decoding():
            return f(*a, **b)

    return inner


def guarded(cls: type) -> type:
    """Class decorator: construction is checked after the class's own __init__, once for a subclass's chain."""
    init = cls.__init__

    @functools.wraps(init)
    def checked(self, *a, **b):
        init(self, *a, **b)
        check_active(type(self).__name__)

    cls.__init__ = checked
    return cls


@dataclass(frozen=True)
class GuardConfig:
    """Which dotted class names are guarded: * is one segment, ** any number; exclusion wins."""

    include: tuple[str, ...] = field(default=())
    exclude: tuple[str, ...] = field(default=())

    @staticmethod
    def _regex(glob: str) -> str:
        return "".join({"**": r".*", "*": r"[^.]*"}.get(p, re.escape(p)) for p in re.split(r"(\*\*|\*)", glob))

    def matches(self, name: str) -> bool:
        hit = lambda globs: any(re.fullmatch(self._regex(g), name) for g in globs)
        return hit(self.include) and not hit(self.exclude)

    def weave(self, module) -> list[str]:
        """Guard the matching classes of a module; returns their names."""
        done = []
        for name, cls in list(vars(module).items()):
            if isinstance(cls, type) and cls.__module__ == module.__name__ and self.matches(f"{module.__name__}.{name}"):
                guarded(cls)
                done.append(name)
        return done
