"""How a vault's conventions map to documents: what is left out, where titles, aliases, tags and types come from."""

from __future__ import annotations

import dataclasses
import hashlib
import os
from dataclasses import dataclass

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str]
_RULES = ("type_by_dir", "type_by_key", "type_by_prefix", "type_by_ext")


@dataclass(frozen=True)
class Profile:
    name: str = "default-obsidian"
    excluded_dirs: tuple[str, ...] = (".obsidian", ".trash", ".git")
    excluded_files: tuple[str, ...] = ()
    excluded_prefixes: tuple[str, ...] = ()
    title_keys: tuple[str, ...] = ("title",)
    alias_keys: tuple[str, ...] = ("aliases",)
    tag_keys: tuple[str, ...] = ("tags",)
    type_by_dir: tuple[Rule, ...] = ()
    type_by_key: tuple[Rule, ...] = ()
    type_by_prefix: tuple[Rule, ...] = ()
    type_by_ext: tuple[Rule, ...] = ()
    type_field: str = "type"
    description_keys: tuple[str, ...] = ("description",)
    resource_keys: tuple[str, ...] = ("resource",)
    default_type: str = "note"
    structural_types: tuple[str, ...] = ("container",)

    @staticmethod
    def parse(text: str) -> Profile:
        """From YAML. Fields that are missing or empty take their defaults, but structural types stay empty if they aren't given."""
        given = yaml.safe_load(text) or {}
        own: dict = {"structural_types": tuple(given.get("structural_types") or ())}
        for f in dataclasses.fields(Profile):
            v = given.get(f.name)
            if not v or f.name == "structural_types":
                continue
            if f.name in _RULES:
                own[f.name] = tuple((str(r["pattern"]), str(r["type"])) for r in v)
            else:
                own[f.name] = str(v) if isinstance(f.default, str) else tuple(map(str, v))
        return Profile(**own)

    def dump(self) -> str:
        out = {}
        for f in dataclasses.fields(self):
            v = getattr(self, f.name)
            out[f.name] = [{"pattern": p, "type": t} for p, t in v] if f.name in _RULES else list(v) if isinstance(v, tuple) else v
        return yaml.safe_dump(out, allow_unicode=True, sort_keys=False)

    def signature(self) -> str:
        return hashlib.sha256(self.dump().encode()).hexdigest()

    def with_excluded_dirs(self, more: list[str]) -> Profile:
        return dataclasses.replace(self, excluded_dirs=(*self.excluded_dirs, *more))

    def excluded_name(self, name: Column) -> Column:
        """Whether a file's name is left out: by its name without .md regardless of case, or by its start."""
        stem = F.regexp_replace(F.regexp_replace(name, r"\.md$", ""), r"\.MD$", "")
        out = F.lit(False)
        for f in self.excluded_files:
            out = out | (F.lower(stem) == f.removesuffix(".md").removesuffix(".MD").lower())
        for p in self.excluded_prefixes:
            if p:
                out = out | name.startswith(p) | stem.startswith(p)
        return out

    def type_of(self, path: Column, meta: Column) -> Column:
        """A document's type: by the start of a front matter key, its type field, the start or a part of its file name, the start of its path, or the default."""
        base = F.element_at(F.split(path, "/"), -1)
        starts = lambda p: F.exists(F.map_keys(meta), lambda k: F.startswith(k, F.lit(p)))
        rules: list[tuple[Column, Column]] = [(starts(p), F.lit(t)) for p, t in self.type_by_key]
        if self.type_field:
            own = F.trim(F.try_element_at(meta, F.lit(self.type_field)))
            rules.append((F.coalesce(own, F.lit("")) != "", own))
        rules += [(base.startswith(p), F.lit(t)) for p, t in self.type_by_prefix]
        rules += [(F.contains(base, F.lit(p)), F.lit(t)) for p, t in self.type_by_ext]
        rules += [(path.startswith(p), F.lit(t)) for p, t in self.type_by_dir]
        return F.coalesce(*[F.when(c, t) for c, t in rules], F.lit(self.default_type))


#: The built-in profiles must sort the same files as other programs do.
#: A wiki written beside its raw material: only the wiki's own pages count.
LLM_WIKI = Profile(
    name="llm-wiki", excluded_dirs=("raw", "audit", "output", "outputs"), excluded_files=("index.md", "log.md", "CLAUDE.md", "AGENTS.md"), structural_types=(),
)
#: An example of all kinds of rules.
EXAMPLE_WIKI = Profile(
    name="example-wiki", title_keys=("title", "name"),
    type_by_dir=(("人物库", "人物"), ("设定库", "设定"), ("线索库", "线索")),
    type_by_key=(("character_id", "人物"), ("setting_id", "设定"), ("clue_id", "线索")),
    type_by_prefix=((".ingest-", "报告"), ("人物_", "人物"), ("设定_", "设定"), ("线索_", "线索")),
    default_type="其他", structural_types=("章节", "大纲", "报告", "画布", "索引", "状态"),
)
BUILT_IN = {"default-obsidian": Profile(), "default": Profile(), "okf": Profile(), "llm-wiki": LLM_WIKI, "example-wiki": EXAMPLE_WIKI}
FOLDER = ".rambleweave"
TEMPLATE = "# Conventions of this vault. Every line is a comment: the defaults hold until one is changed.\n" + "".join(f"# {line}\n" for line in Profile().dump().splitlines())


def resolve_profile(file: str | None = None, name: str | None = None, vault: str | None = None, bootstrap: bool = True) -> Profile:
    """An explicit file, else a built-in name (KeyError if unknown), else the vault's own file, else the default. A vault without a file gets one of comments, if bootstrap."""
    if file:
        with open(file, encoding="utf-8") as f:
            return Profile.parse(f.read())
    if name:
        return BUILT_IN[name]
    if vault:
        path = os.path.join(vault.rstrip("/\\"), FOLDER, "profile.yaml")
        try:
            with open(path, encoding="utf-8") as f:
                text = f.read()
            return Profile.parse(text) if yaml.safe_load(text) else Profile()
        except (OSError, yaml.YAMLError):
            if bootstrap and os.path.isdir(vault) and not os.path.exists(path):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "w", encoding="utf-8") as f:
                    f.write(TEMPLATE)
    return Profile()


def is_llm_wiki(vault: str) -> bool:
    """Whether a folder is laid out as such a wiki: raw/ and wiki/index.md."""
    return os.path.isdir(os.path.join(vault, "raw")) and os.path.exists(os.path.join(vault, "wiki", "index.md"))
