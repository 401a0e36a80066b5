"""Immutable configuration: entities, patterns and contexts, validated when a plan is built."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from spanloom.plans import catalogue

DETECTORS = {"regex", "model", "checked", "address"}
#: Names of detectors in configuration files, and what they are here. Fixed values.
SPOKEN = {"gliner": ("model",), "both": ("regex", "model"), "presidio": ("checked",), "address_model": ("address",)}
REGIONS = {"secrets", "global", "india", "usa", "uk", "meaning", "medical", "custom"}
#: Entities that files call checked and that only a model can find. Fixed values.
MODELLED = {"MEDICAL_DISEASE_DISORDER", "MEDICAL_MEDICATION", "MEDICAL_THERAPEUTIC_PROCEDURE", "MEDICAL_HISTORY", "MEDICAL_FAMILY_HISTORY"}
SEVERITIES = {"low", "medium", "high", "critical"}
STRATEGIES = {"consistent", "label", "mask", "hash"}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Entity:
    name: str
    description: str
    detect_with: tuple[str, ...]
    region: str = "custom"
    replacement: str | None = None
    min_score: float | None = None
    severity: str = "medium"

    @property
    def deterministic(self) -> bool:
        return "regex" in self.detect_with or "checked" in self.detect_with


@dataclass(frozen=True)
class Pattern:
    entity: str
    name: str
    regex: str
    score: float = 0.8


@dataclass(frozen=True)
class Context:
    name: str
    entities: tuple[str, ...]
    threshold: float = 0.4
    strategy: str = "consistent"


@dataclass(frozen=True)
class Config:
    entities: dict[str, Entity]
    patterns: tuple[Pattern, ...]
    contexts: dict[str, Context]
    checked: tuple[tuple[str, str, float, str], ...] = field(default=())

    def context(self, name: str) -> Context:
        if name not in self.contexts:
            raise ConfigError(f"unknown context {name!r}; there are: {', '.join(sorted(self.contexts))}")
        return self.contexts[name]

    def patterns_for(self, entity: str) -> tuple[Pattern, ...]:
        return tuple(p for p in self.patterns if p.entity == entity)


def _score(value, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
        raise ConfigError(f"{what} must be a number from 0 to 1")
    return float(value)


def _bare(replacement: str | None) -> str | None:
    """A replacement without the brackets that files put around it."""
    return replacement.strip("[]") if replacement else None


def entities_of(rows: list[dict]) -> dict[str, Entity]:
    out: dict[str, Entity] = {}
    for r in rows:
        name = r.get("name")
        if not name:
            raise ConfigError("an entity has no name")
        if not re.fullmatch(r"[A-Z][A-Z0-9_]*", name):
            raise ConfigError(f"{name}: names are upper case with underscores")
        if name in out:
            raise ConfigError(f"{name} is there twice")
        if not r.get("description"):
            raise ConfigError(f"{name} has no description")
        how = [r["detect_with"]] if isinstance(r.get("detect_with"), str) else r.get("detect_with") or ()
        how = tuple(dict.fromkeys(y for x in how for y in SPOKEN.get(x, (x,))))
        if not how or set(how) - DETECTORS:
            raise ConfigError(f"{name}: detect_with must name some of {sorted(DETECTORS)}")
        if r.get("severity", "medium") not in SEVERITIES:
            raise ConfigError(f"{name}: unknown severity")
        if r.get("region", "custom") not in REGIONS:
            raise ConfigError(f"{name}: unknown region")
        low = r.get("min_score")
        out[name] = Entity(name, r["description"], how, r.get("region", "custom"), _bare(r.get("replacement")), None if low is None else _score(low, f"{name}: min_score"), r.get("severity", "medium"))
    return out


def patterns_of(groups: dict[str, list[dict]], entities: dict[str, Entity]) -> tuple[Pattern, ...]:
    out = []
    for entity, rows in groups.items():
        if entity not in entities:
            raise ConfigError(f"a pattern names the unknown entity {entity}")
        if not isinstance(rows, list):
            raise ConfigError(f"{entity}: patterns must be a list")
        for k, r in enumerate(rows):
            if not r.get("regex"):
                raise ConfigError(f"{entity}: a pattern has no regex")
            try:
                re.compile(r["regex"])
            except re.error as e:
                raise ConfigError(f"{entity}: a pattern does not compile ({e})") from e
            out.append(Pattern(entity, r.get("name", f"{entity.lower()}_{k}"), r["regex"], _score(r.get("score", 0.8), f"{entity}: score")))
    return tuple(out)


def _members(name: str, said: list[str], seed: list[str]) -> list[str]:
    """Absolute names replace; +X adds, -X removes; none inherit."""
    if not said:
        return list(seed)
    signed = [x[0] in "+-" for x in said]
    if any(signed) and not all(signed):
        raise ConfigError(f"context {name}: deltas and plain names are mixed")
    if not all(signed):
        return list(dict.fromkeys([*seed, *said]))
    out = list(seed)
    for x in said:
        if x[0] == "+" and x[1:] not in out:
            out.append(x[1:])
        elif x[0] == "-":
            out = [y for y in out if y != x[1:]]
    return out


def contexts_of(rules: dict[str, dict], entities: dict[str, Entity], need_default: bool = True) -> dict[str, Context]:
    if not rules:
        raise ConfigError("there are no contexts")
    if need_default and "default" not in rules:
        raise ConfigError("there is no context named default")
    out: dict[str, Context] = {}

    def resolve(name: str, path: tuple[str, ...]) -> Context:
        if name in path:
            raise ConfigError(f"contexts inherit in a circle: {' > '.join([*path, name])}")
        if name not in rules:
            raise ConfigError(f"context {path[-1]} inherits the undefined {name}")
        if name in out:
            return out[name]
        r = rules[name]
        parent = resolve(r["inherits"], (*path, name)) if r.get("inherits") else None
        regions = [r["regions"]] if isinstance(r.get("regions"), str) else r.get("regions") or []
        if not isinstance(regions, list) or set(regions) - REGIONS:
            raise ConfigError(f"context {name}: bad regions")
        seed = [e.name for e in entities.values() if e.region in regions] if regions else list(parent.entities) if parent else []
        if regions and not seed:
            raise ConfigError(f"context {name}: no entity is in regions {regions}")
        members = _members(name, r.get("entities") or [], seed)
        if not members:
            raise ConfigError(f"context {name} is empty")
        if unknown := set(members) - set(entities):
            raise ConfigError(f"context {name} names unknown entities: {sorted(unknown)}")
        threshold = r.get("threshold")
        threshold = _score(threshold, f"context {name}: threshold") if threshold is not None else parent.threshold if parent else 0.4
        strategy = r.get("strategy") or (parent.strategy if parent else "consistent")
        if strategy not in STRATEGIES:
            raise ConfigError(f"context {name}: unknown strategy {strategy}")
        out[name] = Context(name, tuple(members), threshold, strategy)
        return out[name]

    for name in rules:
        resolve(name, ())
    return out


def _whole(config: Config) -> Config:
    for e in config.entities.values():
        if "regex" in e.detect_with and not config.patterns_for(e.name):
            raise ConfigError(f"{e.name} is found by regex but has no pattern")
    return config


def from_dicts(taxonomy: list[dict], patterns: dict[str, list[dict]] | None = None, rules: dict[str, dict] | None = None) -> Config:
    """Without rules, the context ``default`` has all entities at 0.3, consistent."""
    entities = entities_of(taxonomy)
    rules = rules or {"default": {"entities": list(entities), "threshold": 0.3, "strategy": "consistent"}}
    return _whole(Config(entities, patterns_of(patterns or {}, entities), contexts_of(rules, entities)))


def extend(base: Config, taxonomy: list[dict] = (), patterns: dict[str, list[dict]] | None = None, contexts: dict[str, dict] | None = None) -> Config:
    """A new Config; base is untouched. Known entities cannot be defined again; a context of the same name takes over."""
    new = entities_of(list(taxonomy))
    if clash := set(new) & set(base.entities):
        raise ConfigError(f"already defined: {sorted(clash)}")
    entities = {**base.entities, **new}
    flat = {c.name: {"entities": list(c.entities), "threshold": c.threshold, "strategy": c.strategy} for c in base.contexts.values()}
    got = contexts_of({**flat, **(contexts or {})}, entities, need_default=False)
    return _whole(replace(base, entities=entities, patterns=base.patterns + patterns_of(patterns or {}, entities), contexts=got))


def load(folder: str) -> Config:
    """taxonomy.yaml (``entities``), patterns.yaml (lists by entity, also under ``patterns``) and rules.yaml (``contexts``) of a folder on the driver."""
    import yaml

    def read(name: str):
        try:
            with open(f"{folder}/{name}.yaml", encoding="utf-8") as f:
                got = yaml.safe_load(f)
        except OSError as e:
            raise ConfigError(f"{name}.yaml cannot be read") from e
        if not isinstance(got, dict):
            raise ConfigError(f"{name}.yaml must hold a mapping")
        return got

    said = read("patterns")
    got = from_dicts(read("taxonomy").get("entities", []), said.get("patterns", said), read("rules").get("contexts", {}))
    if missing := sorted(e.name for e in got.entities.values() if "checked" in e.detect_with and e.name not in {x[0] for x in catalogue.CHECKED} | MODELLED):
        raise ConfigError(f"no checked format exists for {missing}")
    return replace(got, checked=tuple(x for x in catalogue.CHECKED if x[0] in got.entities and "checked" in got.entities[x[0]].detect_with))


def shipped() -> Config:
    taxonomy = [{"name": n, "description": n.replace("_", " ").lower(), "detect_with": how.split(), "region": region, "replacement": put, "min_score": catalogue.FLOORS.get(n)} for n, (region, how, put) in catalogue.ENTITIES.items()]
    groups: dict[str, list[dict]] = {}
    for entity, name, regex, score in catalogue.PATTERNS:
        groups.setdefault(entity, []).append({"name": name, "regex": regex, "score": score})
    rules = {n: {"inherits": a, "regions": b, "entities": c, "threshold": d, "strategy": e} for n, (a, b, c, d, e) in catalogue.RULES.items()}
    return replace(from_dicts(taxonomy, groups, rules), checked=tuple(catalogue.CHECKED))


def active(config: Config, context: str, requested: list[str] | None = None) -> list[str]:
    """The requested entities that the context has, in the requested order."""
    own = config.context(context).entities
    return [e for e in requested if e in own] if requested is not None else list(own)


def models_needed(config: Config, entities: list[str]) -> set[str]:
    return {d for e in entities for d in config.entities[e].detect_with if d in ("model", "address")}


def of_regions(config: Config, regions: list[str]) -> list[str]:
    """All entities of some regions, whether or not a context has them."""
    return [e.name for e in config.entities.values() if e.region in regions]


def preferences(path: str) -> dict:
    """``entities`` (None: not chosen) and ``ocr_langs`` of a YAML file on the driver; without the file both are unset."""
    import os

    import yaml

    said = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            said = yaml.safe_load(f) or {}
    return {"entities": said.get("entities"), "ocr_langs": list(said.get("ocr_langs") or [])}
