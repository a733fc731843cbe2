"""Detection rules: YAML compiled to Catalyst predicates, all evaluated in one projection.

A rule's selector is a conjunction of fields; a field is `name` or `name|modifier` with contains,
startswith or endswith (only the first modifier counts), and a list of values means any of them.
Matching ignores case; a missing field never matches. Conditions: a selector's name, `any of p*`,
`all of p*`, `A and not B`; of anything else the first word counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Rule:
    """A parsed rule."""

    id: str
    title: str
    level: str
    tags: list[str]
    detection: dict
    techniques: list[str] = field(default_factory=list)


def parse_rules(text: str) -> list[Rule]:
    """The rules of a YAML text with one or more documents; malformed ones are left out."""
    import yaml

    out = []
    try:
        docs = list(yaml.safe_load_all(text))
    except yaml.YAMLError:
        return out
    for doc in docs:
        if isinstance(doc, dict) and isinstance(doc.get("detection"), dict) and doc.get("title"):
            tags = [str(t) for t in doc.get("tags") or []]
            techniques = [t.split(".", 1)[1].upper() for t in tags if t.lower().startswith("attack.t")]
            out.append(Rule(str(doc.get("id") or doc["title"]), str(doc["title"]), str(doc.get("level", "medium")).lower(), tags, doc["detection"], techniques))
    return out


def load_rules(folder: str) -> list[Rule]:
    """All rules of a local folder, in order of file name; rules are few and parsed on the driver."""
    return [r for p in sorted(Path(folder).glob("*.y*ml")) for r in parse_rules(p.read_text(encoding="utf-8"))]


def value_match(column: Column, wanted: object, modifier: str = "") -> Column:
    """Whether a field's text matches a value, or any of a list of values."""
    if isinstance(wanted, list):
        out = F.lit(False)
        for w in wanted:
            out = out | value_match(column, w, modifier)
        return out
    if wanted is None:
        return F.lit(False)
    text, w = F.lower(column.cast("string")), str(wanted).lower()
    found = {"contains": text.contains(w), "startswith": text.startswith(w), "endswith": text.endswith(w)}.get(modifier, text == w)
    return F.coalesce(found, F.lit(False))


def selector(spec: object, get: Callable[[str], Column]) -> Column:
    """A selector's predicate; anything but a mapping never matches."""
    if not isinstance(spec, dict):
        return F.lit(False)
    out = F.lit(True)
    for key, wanted in spec.items():
        name, *modifiers = str(key).split("|")
        out = out & value_match(get(name), wanted, modifiers[0] if modifiers else "")
    return out


def condition(detection: dict, get: Callable[[str], Column]) -> Column:
    """A rule's predicate over its selectors."""
    named = {k: selector(v, get) for k, v in detection.items() if k != "condition"}
    text = str(detection.get("condition", "")).strip()
    never = F.lit(False)
    if text in named:
        return named[text]
    words = text.split()
    if len(words) >= 3 and words[0] in ("any", "all") and words[1] == "of":
        few = [v for k, v in named.items() if k.startswith(words[2].rstrip("*"))]
        out = F.lit(words[0] == "all" and bool(few))
        for x in few:
            out = out & x if words[0] == "all" else out | x
        return out
    if " and not " in text:
        a, b = (x.strip() for x in text.split(" and not ", 1))
        return named.get(a, never) & ~named.get(b, never)
    return named.get(words[0], never) if words else never


def match(df: DataFrame, rules: list[Rule], get: Callable[[str], Column]) -> DataFrame:
    """`df` with matches: the descriptors of all rules that an event matches, by one projection."""
    made = [
        F.when(condition(r.detection, get), F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.title).alias("rule_name"), F.lit(r.level).alias("severity"), F.lit(0.85 if r.level == "high" else 0.60).alias("confidence"), F.array(*map(F.lit, r.techniques)).cast("array<string>").alias("techniques")))
        for r in rules
    ]
    empty = F.array().cast("array<struct<rule_id:string,rule_name:string,severity:string,confidence:double,techniques:array<string>>>")
    return df.withColumn("matches", F.array_compact(F.array(*made)) if made else empty)


def dedup(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Each window's first match of every rule."""
    long = df.select(*keys, order.alias("_order"), F.explode("matches").alias("m"))
    first = long.groupBy(*keys, F.col("m.rule_id").alias("rule_id")).agg(F.min_by("m", "_order").alias("m"), F.count("*").alias("hits"))
    return first.select(*keys, "rule_id", F.col("m.severity").alias("severity"), F.col("m.confidence").alias("confidence"), "hits")
