"""Settings: a TOML file over defaults, rules of what may be in it, what a change calls for, and named variants of a run."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Callable, Mapping, Sequence
from typing import Any

Settings = dict[str, Any]
#: What is wrong with the settings, or None.
Rule = Callable[[Mapping[str, Any]], str | None]


def within(name: str, low: float | None = None, high: float | None = None, open_low: bool = False) -> Rule:
    """A number from low (or above it) to high."""

    def rule(s: Mapping[str, Any]) -> str | None:
        v = s[name]
        if low is not None and (v < low or open_low and v == low):
            return f"{name} must be {'above' if open_low else 'at least'} {low}"
        return f"{name} must be at most {high}" if high is not None and v > high else None

    return rule


def one_of(name: str, allowed: Sequence[Any]) -> Rule:
    return lambda s: None if s[name] in allowed else f"{name} must be one of {', '.join(map(str, allowed))}"


def each_of(name: str, allowed: Sequence[Any]) -> Rule:
    """A list, not empty, of allowed values."""
    return lambda s: f"{name} must not be empty" if not s[name] else next((f"{name}: {v} is not known" for v in s[name] if v not in allowed), None)


def differ(a: str, b: str) -> Rule:
    return lambda s: f"{a} and {b} must differ" if s[a] == s[b] else None


def problems(settings: Mapping[str, Any], rules: Sequence[Rule]) -> list[str]:
    """Everything that is wrong, in the order of the rules."""
    return [p for rule in rules if (p := rule(settings))]


def flat(tree: Mapping[str, Any], before: str = "") -> Settings:
    out: Settings = {}
    for k, v in tree.items():
        out |= flat(v, f"{before}{k}.") if isinstance(v, Mapping) else {before + k: v}
    return out


def load(path: str, defaults: Mapping[str, Any]) -> Settings:
    """The settings of a file (dotted names) over the defaults; names that have no default are left out. No file: the defaults."""
    if not os.path.exists(path):
        return dict(defaults)
    with open(path, "rb") as f:
        found = flat(tomllib.load(f))
    return dict(defaults) | {k: v for k, v in found.items() if k in defaults}


def _value(v: Any) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_value, v)) + "]"
    return repr(v) if isinstance(v, (int, float)) else '"' + str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def save(path: str, settings: Mapping[str, Any]) -> None:
    """All settings, written beside the file and moved there."""
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        f.writelines(f"{k} = {_value(v)}\n" for k, v in sorted(settings.items()))
    os.replace(f"{path}.new", path)


class Watch:
    """Looks whether a file has changed, each time it is asked."""

    def __init__(self, path: str):
        self.path = path
        self.seen = self._stamp()

    def _stamp(self) -> tuple[int, int]:
        try:
            s = os.stat(self.path)
        except FileNotFoundError:
            return (0, -1)
        return (s.st_mtime_ns, s.st_size)

    def changed(self) -> bool:
        now, before = self._stamp(), self.seen
        self.seen = now
        return now != before


def plan(old: Mapping[str, Any], new: Mapping[str, Any], actions: Mapping[str, str]) -> list[str]:
    """What a change of settings calls for: the actions (by setting, or by the beginning of its name), each once, in their order."""
    changed = [k for k in new if new[k] != old.get(k)]
    return list(dict.fromkeys(action for name, action in actions.items() if any(k == name or k.startswith(name + ".") for k in changed)))


def variants(names: Sequence[str], base: Mapping[str, Any], trial: Mapping[str, Any], groups: Mapping[str, Sequence[str]]) -> dict[str, Settings]:
    """Named runs: 'default' (base), 'experimental' (trial), '+group' (base with the trial's settings of a group), '-group' (trial with
    the base's), and 'ablation', which stands for all of these. Unknown names are errors."""
    every = ["default", *(f"+{g}" for g in groups), "experimental", *(f"-{g}" for g in groups)]
    out: dict[str, Settings] = {}
    for name in [n for asked in names for n in (every if asked == "ablation" else [asked])]:
        if name not in every:
            raise ValueError(f"unknown run {name}")
        start, other = (trial, base) if name == "experimental" or name[0] == "-" else (base, trial)
        own = groups[name[1:]] if name[0] in "+-" else ()
        out[name] = dict(start) | {k: other[k] for k in own}
    return out


def described(settings: Mapping[str, Any]) -> str:
    """One line: name value, name value, ..., in order of name; switches by name alone, off ones not at all."""
    return ", ".join(k if v is True else f"{k} {v:g}" if isinstance(v, (int, float)) else f"{k} {v}" for k, v in sorted(settings.items()) if v is not False)
