import pytest

from spanloom.plans.config import ConfigError, active, extend, from_dicts, models_needed, shipped

E = {"name": "A", "description": "a", "detect_with": ["regex"]}
P = {"A": [{"regex": "a+"}]}


def test_shipped_sizes():
    c = shipped()
    assert len(c.entities) == 51 and len(c.patterns) == 38
    sizes = {"default": 16, "secrets": 12, "notes": 16, "identity": 11, "support": 23, "india_only": 14, "usa_only": 5, "uk_only": 6, "medical_only": 6, "india_full": 34, "everything": 51}
    assert {n: len(x.entities) for n, x in c.contexts.items()} == sizes
    assert "EMAIL" not in c.context("notes").entities and c.context("notes").strategy == "consistent"


@pytest.mark.parametrize(
    ("taxonomy", "patterns", "rules"),
    [
        ([{**E, "name": ""}], P, None), ([E, E], P, None), ([{**E, "name": "a"}], P, None), ([{**E, "description": ""}], P, None), ([{**E, "detect_with": []}], P, None), ([{**E, "detect_with": ["x"]}], P, None),
        ([{**E, "severity": "x"}], P, None), ([{**E, "region": "x"}], P, None), ([{**E, "min_score": 2}], P, None), ([E], {"B": [{"regex": "a"}]}, None), ([E], {"A": {"regex": "a"}}, None), ([E], {"A": [{}]}, None),
        ([E], {"A": [{"regex": "("}]}, None), ([E], {"A": [{"regex": "a", "score": -1}]}, None), ([E], {}, None), ([E], P, {"x": {"entities": ["A"]}}), ([E], P, {"default": {"inherits": "x"}, "x": {"inherits": "default"}}),
        ([E], P, {"default": {"inherits": "y"}}), ([E], P, {"default": {"regions": ["x"]}}), ([E], P, {"default": {"regions": ["uk"]}}), ([E], P, {"default": {"entities": ["A", "+A"]}}), ([E], P, {"default": {}}),
        ([E], P, {"default": {"entities": ["Z"]}}), ([E], P, {"default": {"entities": ["A"], "threshold": 3}}), ([E], P, {"default": {"entities": ["A"], "strategy": "x"}}),
    ],
)
def test_refusals(taxonomy, patterns, rules):
    with pytest.raises(ConfigError):
        from_dicts(taxonomy, patterns, rules)


def test_implicit_rules_and_extend():
    c = from_dicts([E], P)
    assert (c.context("default").threshold, c.context("default").entities) == (0.3, ("A",))
    more = extend(c, [{"name": "B", "description": "b", "detect_with": ["regex"]}], {"B": [{"regex": "b"}]}, {"both": {"inherits": "default", "entities": ["+B"]}})
    assert more.context("both").entities == ("A", "B") and "B" not in c.entities
    with pytest.raises(ConfigError):
        extend(c, [E])
    with pytest.raises(ConfigError):
        extend(c, contexts={"x": {"entities": ["Q"]}})
    with pytest.raises(ConfigError):
        c.context("none")


def test_active_and_models():
    c = shipped()
    assert active(c, "default", ["PERSON", "UK_NHS", "EMAIL"]) == ["PERSON", "EMAIL"]
    assert models_needed(c, ["EMAIL", "PHONE", "ADDRESS"]) == {"model", "address"}
