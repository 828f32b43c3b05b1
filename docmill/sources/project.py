"""Which store a working folder uses."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

#: What marks the root of a project.
MARKERS = (".git", "package.json", "Cargo.toml", "pyproject.toml", "go.mod", "pom.xml", "build.gradle", ".project", "Gemfile", "composer.json")
FOLDER = ".docmill"


@dataclass(frozen=True)
class ProjectInfo:
    is_project: bool
    project_root: Path | None
    database_path: Path
    project_name: str | None


def find_root(start: Path) -> Path | None:
    """The nearest folder, from ``start`` upwards, that holds a marker."""
    start = Path(start).resolve()
    return next((p for p in (start, *start.parents) if any((p / m).exists() for m in MARKERS)), None)


def project_info(start: Path, global_folder: Path) -> ProjectInfo:
    """The project around ``start`` with its own store, or the global one. Nothing is created."""
    root = find_root(start)
    if root is None:
        return ProjectInfo(False, None, Path(global_folder) / "store", None)
    return ProjectInfo(True, root, root / FOLDER / "store", root.name)
