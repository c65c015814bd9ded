"""What a run is set to, and the small files it keeps: settings, glossaries, output names."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass, field
from typing import get_type_hints

from palimp.functions.jsonfix import read_entry

TEXT_STAGES = ["glossary", "translate", "judge", "reflect", "proofread", "style", "verify", "repair"]


class SettingsError(ValueError):
    """A settings or glossary file that cannot be used."""


@dataclass
class Provider:
    base_url: str | None = None
    api_key_env: str | None = None
    extra_headers: dict = field(default_factory=dict)
    max_response_bytes: int | None = None


@dataclass
class Providers:
    """The endpoint of every text stage is ``text``, unless it has one of its own."""

    text: Provider = field(default_factory=Provider)
    image: Provider = field(default_factory=Provider)
    stages: dict = field(default_factory=dict)

    def of(self, stage: str) -> Provider:
        return self.stages.get(stage) or self.text


@dataclass
class Chunker:
    target_words: int = 2000
    overlap_paragraphs: int = 1


@dataclass
class Notes:
    enabled: bool = False
    types: list = field(default_factory=lambda: ["person", "place", "concept", "term"])
    scope: str = "first-in-book"

    def wanted(self, flag: bool | None = None, types: str | None = None) -> Notes | None:
        """These settings as a command's flags change them; None if notes are not wanted. ``flag`` overrides
        ``enabled``, ``types`` (separated by commas) the types."""
        if not (self.enabled if flag is None else flag):
            return None
        return dataclasses.replace(self, enabled=True, types=[t.strip() for t in types.split(",")] if types else list(self.types))


@dataclass
class Repair:
    enabled: bool = True
    categories: list = field(default_factory=lambda: ["grammar", "markup", "accuracy"])


@dataclass
class Reflection:
    enabled: bool = True
    trigger: int = 2


@dataclass
class Settings:
    source_lang: str = "en"
    target_lang: str = "ru"
    target_lang_name: str | None = None
    providers: Providers = field(default_factory=Providers)
    models: dict = field(default_factory=dict)
    chunker: Chunker = field(default_factory=Chunker)
    reader_notes: Notes = field(default_factory=Notes)
    repair: Repair = field(default_factory=Repair)
    reflection: Reflection = field(default_factory=Reflection)


def load(path: str | None = None) -> Settings:
    """The settings of a YAML or JSON file, what it lacks at its default; all defaults without a path. A missing
    file, a field that is not known or a value of another kind is an error."""
    if path is None:
        return Settings()
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no settings at {path}")
    with open(path, encoding="utf-8") as held:
        text = held.read()
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        import yaml

        raw = yaml.safe_load(text)
    return _made(Settings, raw or {}, "settings")


def _made(kind: type, raw, where: str):
    if not isinstance(raw, dict):
        raise SettingsError(f"{where} is no mapping")
    if kind is Providers:
        raw = {**raw, "stages": {s: _made(Provider, raw[s], f"{where}.{s}") for s in TEXT_STAGES if raw.get(s) is not None}}
        raw = {k: v for k, v in raw.items() if k not in TEXT_STAGES}
    hints, values = get_type_hints(kind), {}
    for name, value in raw.items():
        if name not in hints:
            raise SettingsError(f"{where}.{name} is not known")
        hint = hints[name]
        if dataclasses.is_dataclass(hint):
            value = _made(hint, value, f"{where}.{name}")
        elif not isinstance(value, hint if isinstance(hint, type) else hint.__args__):
            raise SettingsError(f"{where}.{name} is {type(value).__name__}")
        values[name] = value
    return kind(**values)


#: File endings of media types.
EXTENSIONS = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif", "image/bmp": ".bmp", "image/tiff": ".tiff"}


def extension(media_type: str | None) -> str:
    """The file ending of a media type, its parameters aside; ``.jpg`` for none and unknown ones."""
    return EXTENSIONS.get((media_type or "").partition(";")[0].strip().lower(), ".jpg")


def output_path(archive: str, language: str) -> str:
    return f"{os.path.splitext(archive)[0]}-{language}.epub"


def only_store(base: str, name: str | None = None, marker: str = "revisions.parquet") -> str:
    """The store below ``base`` called ``name`` or, without a name, the only one there is; else an error."""
    held = [name] if name else sorted(n for n in (os.listdir(base) if os.path.isdir(base) else []) if os.path.exists(os.path.join(base, n, marker)))
    if len(held) != 1 or not os.path.exists(os.path.join(base, held[0], marker)):
        raise SettingsError(f"no store at {base}" if not held or name else f"several stores, name one of {', '.join(held)}")
    return os.path.join(base, held[0])


def save_json(value, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(value, out, ensure_ascii=False, indent=2)


def load_glossary(path: str) -> dict:
    """A glossary file, of a book or a series: ``{"title", …, "entries": [...]}``, or a bare list of entries. An entry
    that is not valid makes the file unusable."""
    try:
        with open(path, encoding="utf-8") as held:
            raw = json.load(held)
    except (OSError, ValueError) as e:
        raise SettingsError(f"cannot read {path}: {e}") from e
    raw = {"entries": raw} if isinstance(raw, list) else raw
    if not isinstance(raw, dict) or not isinstance(raw.get("entries"), list):
        raise SettingsError(f"{path} has no entries")
    entries = []
    for n, item in enumerate(raw["entries"]):
        entry = read_entry(item)
        if entry is None:
            raise SettingsError(f"entry {n} of {path} is not valid")
        entries.append(entry | {k: item[k] for k in ("approved_by_human", "origin_book") if k in item})
    return raw | {"entries": entries}


def init_series(base: str, slug: str, title: str, author: str, source_lang: str = "en", target_lang: str = "ru") -> str:
    """An empty series glossary below ``base``; one that exists is an error. Returns its path."""
    path = os.path.join(base, f"{slug}-series", "glossary.json")
    if os.path.exists(path):
        raise FileExistsError(f"there is a series at {path}")
    save_json({"series_slug": slug, "title": title, "author": author, "source_lang": source_lang, "target_lang": target_lang, "entries": []}, path)
    return path
