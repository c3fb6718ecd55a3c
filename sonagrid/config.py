"""Configurations whose values refer to each other and name what is to be made of them."""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import SparkSession

#: A value that stands for another key's value, alone or as a part of a path.
REFERENCE = re.compile(r"<([a-zA-Z]\w*)>")


def parse(text: str) -> object:
    """A value or document in YAML; without a YAML library, in JSON or as plain text."""
    try:
        import yaml
    except ModuleNotFoundError:
        try:
            return json.loads(text)
        except ValueError:
            return text
    return yaml.safe_load(text)


def load(spark: SparkSession, path: str) -> dict:
    """The document at ``path``, from any store that Spark reads."""
    if not path.endswith((".yaml", ".yml", ".json")):
        raise ValueError(f"{path}: unknown kind of configuration")
    found = spark.read.option("wholetext", True).text(path).collect()
    if len(found) != 1:
        raise ValueError(f"{path}: {len(found)} files")
    return parse(found[0]["value"]) or {}


def with_overrides(config: Mapping, arguments: Sequence[str]) -> dict:
    """``config`` with keys set by arguments '--key=value' or '--key value ...'; values are read as in the document."""
    said: dict[str, list[str]] = {}
    for part in (p for a in arguments for p in (a.split("=", 1) if a.startswith("--") else [a])):
        if part.startswith("--"):
            said[key := part[2:]] = []
        elif not said:
            raise ValueError(f"{part!r} before any --key")
        else:
            said[key].append(part)
    return {**config, **{k: parse(" ".join(v)) if v else None for k, v in said.items()}}


def references(value: object) -> Iterator[str]:
    """The keys that ``value`` refers to, at any depth."""
    if isinstance(value, Mapping):
        for v in value.values():
            yield from references(v)
    elif isinstance(value, list | tuple):
        for v in value:
            yield from references(v)
    elif isinstance(value, str):
        for part in value.split("/"):
            if m := REFERENCE.fullmatch(part):
                yield m[1]


def order(config: Mapping, *names: str) -> list[str]:
    """The keys needed for ``names``, each after those that it refers to. Unknown keys and circles are errors."""
    done: dict[str, None] = {}
    for name in names:
        path: list[str] = []  # open keys, outermost first
        left: list[Iterator[str]] = [iter((name,))]
        while left:
            key = next(left[-1], None)
            if key is None:
                left.pop()
                if path:
                    done[path.pop()] = None
                continue
            if key in done:
                continue
            if key in path:
                raise ValueError("keys refer to each other: " + " -> ".join([*path[path.index(key) :], key]))
            if key not in config:
                raise KeyError(f"{key}, which {path[-1] if path else 'the caller'} refers to, isn't configured")
            path.append(key)
            left.append(references(config[key]))
    return list(done)


def imported(name: str) -> Callable:
    module, _, attribute = name.rpartition(".")
    return getattr(importlib.import_module(module), attribute)


def build(config: Mapping, *names: str, registry: Mapping[str, Callable] | None = None) -> list:
    """The values of ``names``, with references replaced and {obj, args} made into what ``obj`` returns for ``args``.

    ``obj`` is a name in ``registry`` or the import path of a callable. Each key is made once, in the order of its needs,
    and shared by all that refer to it; ``config`` stays as it is.
    """
    known = registry or {}
    made: dict[str, object] = {}

    def of(value: object) -> object:
        if isinstance(value, str):
            if m := REFERENCE.fullmatch(value):
                return made[m[1]]
            return "/".join(str(made[m[1]]) if (m := REFERENCE.fullmatch(p)) else p for p in value.split("/"))
        if isinstance(value, list | tuple):
            return [of(v) for v in value]
        if isinstance(value, Mapping):
            if {"obj", "args"} <= value.keys():
                if not isinstance(value["args"], Mapping):
                    raise TypeError(f"args of {value['obj']} must be a mapping")
                return (known.get(value["obj"]) or imported(value["obj"]))(**of(value["args"]))
            return {k: of(v) for k, v in value.items()}
        return value

    for key in order(config, *names):
        made[key] = of(config[key])
    return [made[n] for n in names]
