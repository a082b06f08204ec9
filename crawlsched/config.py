"""Settings from lines of text: ``name = value``, with typed access."""

from __future__ import annotations

from collections.abc import Iterable


def parse_lines(lines: Iterable[str]) -> dict[str, str]:
    """Split at the first ``=`` and trim; a bare name has an empty value; blank lines and # comments are left out."""
    out = {}
    for line in lines:
        line = line.strip()
        if line and not line.startswith("#"):
            name, _, value = line.partition("=")
            out[name.strip()] = value.strip()
    return out


def _number(config: dict[str, str], name: str, default, kind):
    text = config.get(name)
    if not text:
        return default
    try:
        return kind(text)
    except ValueError as e:
        raise ValueError(f"setting {name}: {text!r} is not a number") from e


def integer(config: dict[str, str], name: str, default: int | None = None) -> int | None:
    """Empty or missing gives the default; anything but a 64-bit number raises."""
    found = _number(config, name, default, int)
    if found is not None and not -(2**63) <= found < 2**63:
        raise ValueError(f"setting {name}: {found} is out of range")
    return found


def real(config: dict[str, str], name: str, default: float | None = None) -> float | None:
    return _number(config, name, default, float)


def string(config: dict[str, str], name: str, default: str = "") -> str:
    return config.get(name) or default


def boolean(config: dict[str, str], name: str, default: bool = False) -> bool:
    """Empty or missing gives the default; only ``true``, in any case, is true."""
    text = config.get(name)
    return text.lower() == "true" if text else default


def flag(config: dict[str, str], name: str, default: bool = False) -> bool:
    """As ``boolean``, but a bare name is true."""
    if name not in config:
        return default
    return not config[name] or config[name].lower() == "true"
