"""Every module of the package imports, and no function uses a name that its module does not have."""

from __future__ import annotations

import builtins
import dis
import importlib
import pkgutil
from types import CodeType

import pytest

import streamgrid

MODULES = sorted(
    m.name for m in pkgutil.walk_packages(streamgrid.__path__, "streamgrid.") if not m.name.startswith("streamgrid.llm")
)


def global_names(code: CodeType) -> set[str]:
    found = {i.argval for i in dis.get_instructions(code) if i.opname in ("LOAD_GLOBAL", "LOAD_NAME")}
    return found.union(*(global_names(c) for c in code.co_consts if isinstance(c, CodeType)))


@pytest.mark.parametrize("name", MODULES)
def test_names_are_defined(name):
    module = importlib.import_module(name)
    with open(module.__file__) as f:
        code = compile(f.read(), module.__file__, "exec")
    missing = {n for n in global_names(code) if not hasattr(module, n) and not hasattr(builtins, n)}
    # Names of class bodies and annotations are not in the module.
    assert missing <= {"__module__", "__qualname__", "__name__", "__doc__", "__annotations__", "__classdict__"} | {
        v for c in vars(module).values() if isinstance(c, type) for v in vars(c)
    }
