"""Objects that remember what they were made with, so that they can be stored as JSON and made again."""

from __future__ import annotations

from importlib import import_module
from typing import Any


class Described:
    """Base of walkers, samplers and embedders: keeps the arguments of its construction."""

    def __new__(cls, *args, **options):
        made = super().__new__(cls)
        made.made_with = (args, options)
        return made


def _name(what: Any) -> str:
    name = f"{what.__module__}:{what.__qualname__}"
    if "<" in name:
        raise ValueError(f"{name} can't be stored, as no module has it by that name")
    return name


def _found(name: str) -> Any:
    module, _, path = name.partition(":")
    found = import_module(module)
    for part in path.split("."):
        found = getattr(found, part)
    return found


def describe(what: Any) -> Any:
    """A value in JSON's terms; described objects and functions by the names that modules have for them."""
    if isinstance(what, Described):
        args, options = what.made_with
        return {"class": _name(type(what)), "args": [describe(x) for x in args], "options": {k: describe(x) for k, x in options.items()}}
    if isinstance(what, (list, tuple)):
        return [describe(x) for x in what]
    if callable(what):
        return {"function": _name(what)}
    return what


def rebuild(text: Any, kind: type = object) -> Any:
    """What :func:`describe` gave, made again; ValueError if it is not of that kind."""
    if isinstance(text, list):
        return [rebuild(x) for x in text]
    if not isinstance(text, dict):
        return text
    if "function" in text:
        return _found(text["function"])
    made = _found(text["class"])
    if not (isinstance(made, type) and issubclass(made, Described) and issubclass(made, kind)):
        raise ValueError(f"{text['class']} is no {kind.__name__}")
    return made(*[rebuild(x) for x in text["args"]], **{k: rebuild(x) for k, x in text["options"].items()})
