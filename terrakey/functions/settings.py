"""Settings of a round, and their overrides as text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

Value = bool | int | float | str


def overridden(settings: Mapping[str, Value], texts: Iterable[str]) -> dict[str, Value]:
    """Settings with ``name=value`` texts applied in order, each value in the type that the setting has.

    1, true and yes, in any case, are true; all else is false. An unknown name, a missing = or a value of another type is
    an error, so that no round runs with settings it wasn't asked for.
    """
    out = dict(settings)
    for text in texts:
        name, sign, value = text.partition("=")
        if not sign or name not in out:
            raise ValueError(f"not a setting: {text!r}")
        kind = type(out[name])
        out[name] = value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
    return out
