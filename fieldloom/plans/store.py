"""A store of named datasets that are built once and reused until something they are made from changes.

A target is a function that returns a DataFrame, with the files it reads, the targets it uses and its parameters. Its
fingerprint covers all of them: the text of the function and of every own function, class and plain constant it reaches, the
parameters, path, size and time of change of the files, and the fingerprints of the used targets. A version lies in
``root/name/fingerprint``.

- **Reuse**: a published version is read again; nothing runs and nothing is written.
- **Atomic publication**: a version is written beside its place and renamed, so readers never see half of one. Of two runs that build
  the same version one publishes, the other one drops its copy.
- **Rebuild**: a changed input changes the fingerprints of what depends on it, and of nothing else.
- **Removal**: ``prune`` deletes the versions that no target of this store object refers to.

Spark's rename must be atomic for the folder's file system (local disks and HDFS are; for object stores use one with atomic folders).
"""

from __future__ import annotations

import builtins
import hashlib
import inspect
import json
import sys
import sysconfig
import time
import types
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..sources import folders

#: Half-written versions of other runs are kept this long.
STALE_MS = 24 * 3600 * 1000

_FOREIGN = tuple({sysconfig.get_paths()[k] for k in ("stdlib", "platstdlib", "purelib", "platlib")})


def _own(module: str | None) -> bool:
    """Whether a module belongs to the user: neither Python's nor an installed package's."""
    path = getattr(sys.modules.get(module or ""), "__file__", None)
    return module not in sys.builtin_module_names and (path is None or not path.startswith(_FOREIGN))


def _names(code: types.CodeType) -> set[str]:
    """Global and attribute names that a function and the functions inside it use."""
    inner = (c for c in code.co_consts if isinstance(c, types.CodeType))
    return set(code.co_names).union(*map(_names, inner))


def _text(item: Any) -> str:
    try:
        return inspect.getsource(item)
    except (OSError, TypeError):
        code = getattr(item, "__code__", None)
        return repr((code.co_code.hex(), [c for c in code.co_consts if not isinstance(c, types.CodeType)])) if code else repr(item)


def code_text(fn: Callable) -> str:
    """The text of a function and of everything own that it reaches, in a fixed order."""
    seen: dict[str, str] = {}
    todo: list[Any] = [fn]
    while todo:
        item = todo.pop()
        item = inspect.unwrap(item) if callable(item) else item
        key = f"{item.__module__}.{item.__qualname__}"
        if key in seen:
            continue
        seen[key] = _text(item)
        functions = [item] if isinstance(item, types.FunctionType) else [f for f in vars(item).values() if isinstance(f, types.FunctionType)]
        for f in functions:
            names = _names(f.__code__)
            cells = dict(zip(f.__code__.co_freevars, (c.cell_contents for c in f.__closure__ or ()), strict=False))
            reach = {n: f.__globals__.get(n) for n in names} | cells
            for module in [m for m in reach.values() if isinstance(m, types.ModuleType) and _own(m.__name__)]:
                reach |= {f"{module.__name__}.{n}": getattr(module, n, None) for n in names if hasattr(module, n)}
            for name, value in reach.items():
                if isinstance(value, (types.FunctionType, type)) and _own(value.__module__) and getattr(builtins, value.__name__, None) is not value:
                    todo.append(value)
                elif isinstance(value, (str, int, float, bool, tuple, list, dict, set, frozenset)) and not name.startswith("__"):
                    seen[f"{key}:{name}"] = repr(sorted(value, key=repr) if isinstance(value, (set, frozenset)) else value)
            seen[f"{key}:defaults"] = repr((f.__defaults__, f.__kwdefaults__))
    return json.dumps(sorted(seen.items()))


class Store:
    """Targets below ``root``; ``log`` lists (name, ``built`` or ``reused``) in the order of the calls."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.current: dict[str, str] = {}
        self.log: list[tuple[str, str]] = []

    def fingerprint(self, build: Callable, inputs: Mapping[str, str], uses: Sequence[str], params: Mapping[str, Any]) -> str:
        missing = [n for n in uses if n not in self.current]
        if missing:
            raise ValueError(f"targets not made yet: {missing}")
        made_from = {"code": code_text(build), "params": dict(params), "uses": [(n, self.current[n]) for n in uses],
                     "inputs": {n: folders.files_below(self.spark, p) for n, p in inputs.items()}}
        return hashlib.sha256(json.dumps(made_from, sort_keys=True, default=repr).encode()).hexdigest()[:32]

    def path(self, name: str) -> str:
        return f"{self.root}/{name}/{self.current[name]}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def target(self, name: str, build: Callable[..., DataFrame], inputs: Mapping[str, str] | None = None, uses: Sequence[str] = (),
               partition_by: Sequence[str] = (), **params: Any) -> DataFrame:
        """The dataset ``name``: ``build(spark, *used tables, **input paths, **params)``, or its stored version."""
        if "/" in name or name.startswith((".", "_")):
            raise ValueError(f"{name!r} is not a plain name")
        inputs = dict(inputs or {})
        self.current[name] = self.fingerprint(build, inputs, uses, {**params, "partition_by": list(partition_by)})
        final = self.path(name)
        if folders.exists(self.spark, f"{final}/_SUCCESS"):
            self.log.append((name, "reused"))
            return self.read(name)
        draft = f"{self.root}/{name}/.draft-{uuid.uuid4().hex}"
        df = build(self.spark, *[self.read(n) for n in uses], **inputs, **params)
        df.write.partitionBy(*partition_by).parquet(draft)
        if folders.exists(self.spark, f"{final}/_SUCCESS") or not folders.move(self.spark, draft, final):
            folders.remove(self.spark, draft)  # another run was first
            if not folders.exists(self.spark, f"{final}/_SUCCESS"):
                raise OSError(f"{final} cannot be published")
        self.log.append((name, "built"))
        return self.read(name)

    def prune(self) -> list[str]:
        """Remove every version that this store object does not refer to; gives their paths below the root."""
        gone = []
        for name, folder, _ in folders.entries(self.spark, self.root):
            if not folder:
                continue
            for version, _, changed in folders.entries(self.spark, f"{self.root}/{name}"):
                stale = not version.startswith(".draft-") or changed < time.time() * 1000 - STALE_MS
                if version != self.current.get(name) and stale:
                    folders.remove(self.spark, f"{self.root}/{name}/{version}")
                    gone.append(f"{name}/{version}")
            if not folders.entries(self.spark, f"{self.root}/{name}"):
                folders.remove(self.spark, f"{self.root}/{name}")
        return gone
