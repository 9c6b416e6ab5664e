"""Profiles: what a judge is told about relevance and kinds of pages, read from JSON and checked."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

# The kinds of pages that every profile describes.
PAGE_KINDS = ("fund_or_product", "document_listing", "category_or_overview", "news_or_article", "company_or_legal", "other")
FOLDER = Path(__file__).resolve().parent / "profile_data"
DEFAULT = "generic"


class UnknownProfile(ValueError):
    pass


@dataclass(frozen=True)
class Profile:
    name: str
    relevance: dict[str, str]
    page_kinds: dict[str, str]
    description: str = ""


def available(folder: Path = FOLDER) -> list[str]:
    return sorted(p.stem for p in folder.glob("*.json"))


def checked(name: str, text: str) -> Profile:
    """A profile of its JSON text; an error where its criteria or kinds are not exactly those asked for."""
    data = json.loads(text)
    relevance, kinds = data.get("relevance", {}), data.get("page_kinds", {})
    if sorted(relevance) != ["false", "true"]:
        raise UnknownProfile(f"{name}: relevance needs a true and a false criterion, and no other")
    if sorted(kinds) != sorted(PAGE_KINDS):
        raise UnknownProfile(f"{name}: page_kinds must be {', '.join(PAGE_KINDS)}, and no other")
    return Profile(name, relevance, kinds, data.get("description", ""))


def load(name: str | None = None, folder: Path = FOLDER) -> Profile:
    """A profile by name, or by the path of its file."""
    path = Path(name or DEFAULT)
    if path.suffix != ".json":
        path = folder / f"{path}.json"
    if not path.exists():
        raise UnknownProfile(f"no profile {name!r}; there are {', '.join(available(folder))}")
    return checked(path.stem, path.read_text("utf-8"))
