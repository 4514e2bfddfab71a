"""Settings: defaults, then the user's file, then the project's; lists are replaced as a whole."""

from __future__ import annotations

from pathlib import Path

DEFAULTS = {"exclude": [], "languages": [], "policies": [], "models": [], "output_format": "table", "limit": 50}
NAME = ".lodegraph.yaml"


def user_file() -> Path:
    return Path.home() / ".config" / "lodegraph" / "config.yaml"


def _read(path: Path) -> dict:
    import yaml

    data = yaml.safe_load(path.read_text()) if path.is_file() else None
    if data is not None and not isinstance(data, dict):
        raise ValueError(f"{path}: a mapping is expected")
    return {k: v for k, v in (data or {}).items() if k in DEFAULTS}


def project_file(start: str = ".") -> Path | None:
    at = Path(start).resolve()
    return next((d / NAME for d in (at, *at.parents) if (d / NAME).is_file()), None)


def load(start: str = ".") -> dict:
    project = project_file(start)
    return DEFAULTS | _read(user_file()) | (_read(project) if project else {})


def change(path: Path, key: str, value=None) -> None:
    """Set a key in a file, or remove it (value None)."""
    import yaml

    if key not in DEFAULTS:
        raise ValueError(f"unknown setting {key!r}")
    data = _read(path)
    data.pop(key, None)
    if value is not None:
        data[key] = value
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(data))
