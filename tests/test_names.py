"""Every module compiles, and every name that a module's functions read from it is there."""

from __future__ import annotations

import builtins
import dis
import importlib
import pkgutil
import types

import proseframe


def codes(code: types.CodeType):
    yield code
    for x in code.co_consts:
        if isinstance(x, types.CodeType):
            yield from codes(x)


def test_no_name_is_missing():
    for info in pkgutil.walk_packages(proseframe.__path__, "proseframe."):
        module = importlib.import_module(info.name)
        if not getattr(module, "__file__", None):
            continue
        with open(module.__file__, encoding="utf-8") as f:
            whole = compile(f.read(), module.__file__, "exec")
        for code in codes(whole):
            for step in dis.get_instructions(code):
                if step.opname == "LOAD_GLOBAL":
                    assert hasattr(module, step.argval) or hasattr(builtins, step.argval), (info.name, code.co_name, step.argval)
