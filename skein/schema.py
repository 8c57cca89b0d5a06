"""Declared graph schemas: labels with ancestors, typed properties, relation patterns; loading, tightening, diffing, export."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
RESERVED_LABELS = {"Document", "Section", "Chunk", "Community", "Task", "Event", "Step", "Decision"}
RESERVED_TYPES = {"HAS_PART", "HAS_CHILD", "NEXT_CHUNK", "MENTIONED_IN", "MATCHES", "RESOLVED_AS", "MEMBER_OF", "DEPENDS_ON"}
TYPES = {"string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType()}
PATTERN = re.compile(r"^\s*([A-Za-z_]\w*)\s*-\s*([A-Za-z_]\w*)\s*->\s*([A-Za-z_]\w*)\s*$")


@dataclass(frozen=True)
class Property:
    name: str
    type: str = "string"
    required: bool = False
    enum: tuple[str, ...] = ()


@dataclass(frozen=True)
class EntityType:
    label: str
    parents: tuple[str, ...] = ()
    properties: tuple[Property, ...] = ()


@dataclass(frozen=True)
class RelationType:
    name: str
    patterns: tuple[tuple[str, str], ...]
    symmetric: bool = False


@dataclass(frozen=True)
class GraphSchema:
    name: str
    entities: tuple[EntityType, ...]
    relations: tuple[RelationType, ...] = ()
    version: str = "1"
    _by: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        self._by.update({e.label: e for e in self.entities})
        if len(self._by) != len(self.entities):
            raise ValueError("a label is declared twice")
        for e in self.entities:
            if not IDENTIFIER.match(e.label) or e.label in RESERVED_LABELS:
                raise ValueError(f"label {e.label!r} can't be used")
            for p in e.properties:
                if p.type not in TYPES or not IDENTIFIER.match(p.name):
                    raise ValueError(f"property {p.name!r} of {e.label} can't be used")
            self.ancestors(e.label)
        for r in self.relations:
            if not IDENTIFIER.match(r.name) or r.name in RESERVED_TYPES:
                raise ValueError(f"relation {r.name!r} can't be used")
            for end in (x for p in r.patterns for x in p):
                if end not in self._by:
                    raise ValueError(f"relation {r.name} names unknown label {end!r}")

    def ancestors(self, label: str) -> list[str]:
        """Nearest first; a cycle or an unknown parent is an error."""
        out, level, path = [], list(self._by[label].parents), {label}
        while level:
            following = []
            for x in level:
                if x == label:
                    raise ValueError(f"{label} is its own ancestor")
                if x not in self._by:
                    raise ValueError(f"{label} has unknown parent {x!r}")
                if x not in path:
                    path.add(x)
                    out.append(x)
                    following += self._by[x].parents
            level = following
        return out

    def labels(self, label: str) -> list[str]:
        return [label, *self.ancestors(label)]

    def properties(self, label: str) -> dict[str, Property]:
        """Own and inherited ones; the nearest wins."""
        out: dict[str, Property] = {}
        for x in self.labels(label):
            for p in self._by[x].properties:
                out.setdefault(p.name, p)
        return out

    def allows(self, source: str, relation: str, target: str) -> bool:
        pairs = {(a, b) for r in self.relations if r.name == relation for a, b in r.patterns}
        pairs |= {(b, a) for r in self.relations if r.name == relation and r.symmetric for a, b in r.patterns}
        return source in self._by and target in self._by and any((a, b) in pairs for a in self.labels(source) for b in self.labels(target))

    def document(self) -> dict:
        return {
            "name": self.name, "version": self.version,
            "entities": [{"label": e.label, "parents": list(e.parents), "properties": [vars(p) | {"enum": list(p.enum)} for p in e.properties]} for e in self.entities],
            "relations": [{"name": r.name, "patterns": [list(p) for p in r.patterns], "symmetric": r.symmetric} for r in self.relations],
        }

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.document(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(label, ancestor, distance), (type, src_label, dst_label) closed under descendants, (label, property, type, required): as small as the schema."""
        closure = [(e.label, x, k) for e in self.entities for k, x in enumerate(self.labels(e.label))]
        labels = [e.label for e in self.entities]
        allowed = [(r.name, a, b) for r in self.relations for a in labels for b in labels if self.allows(a, r.name, b)]
        declared = [(x, p.name, p.type, p.required) for x in labels for p in self.properties(x).values()]
        return (
            spark.createDataFrame(closure, "label string, ancestor string, distance int"),
            spark.createDataFrame(allowed, "type string, src_label string, dst_label string"),
            spark.createDataFrame(declared, "label string, property string, type string, required boolean"),
        )

    def struct_type(self, label: str) -> T.StructType:
        return T.StructType([T.StructField(p.name, TYPES[p.type], not p.required) for p in self.properties(label).values()])


def load(spec: dict | list | str | Path) -> GraphSchema:
    """A schema from a document, a list of shorthands ``A-REL->B``, JSON text, or a JSON file."""
    if isinstance(spec, Path) or isinstance(spec, str) and spec.endswith(".json"):
        spec = json.loads(Path(spec).read_text(encoding="utf-8"))
    if isinstance(spec, str):
        spec = json.loads(spec)
    if isinstance(spec, list):
        found: dict[str, list[tuple[str, str]]] = {}
        labels: dict[str, None] = {}
        for line in spec:
            m = PATTERN.match(line)
            if not m:
                raise ValueError(f"not a pattern: {line!r}")
            a, name, b = m.groups()
            labels |= {a: None, b: None}
            found.setdefault(name, []).append((a, b))
        return GraphSchema("shorthand", tuple(EntityType(x) for x in labels), tuple(RelationType(n, tuple(p)) for n, p in found.items()))
    entities = tuple(EntityType(e["label"], tuple(e.get("parents", ())), tuple(Property(p["name"], p.get("type", "string"), p.get("required", False), tuple(p.get("enum", ()))) for p in e.get("properties", ()))) for e in spec["entities"])
    relations = tuple(RelationType(r["name"], tuple(tuple(p) for p in r["patterns"]), r.get("symmetric", False)) for r in spec.get("relations", ()))
    return GraphSchema(spec.get("name", "schema"), entities, relations, str(spec.get("version", "1")))


def extend(base: GraphSchema, child: GraphSchema, exclude: tuple[str, ...] = ()) -> GraphSchema:
    """The base with the child's types over it. A child may only tighten what it overrides: no fewer required properties, no wider enums, no other types."""
    kept = {e.label: e for e in base.entities if e.label not in exclude}
    for e in child.entities:
        if e.label in kept:
            own = {p.name: p for p in e.properties}
            for p in kept[e.label].properties:
                new = own.get(p.name, p)
                if new.type != p.type or p.required and not new.required or p.enum and not (new.enum and set(new.enum) <= set(p.enum)):
                    raise ValueError(f"{e.label}.{p.name} is loosened")
                own.setdefault(p.name, p)
            e = replace(e, parents=e.parents or kept[e.label].parents, properties=tuple(own.values()))
        kept[e.label] = e
    relations = {r.name: r for r in base.relations}
    for r in child.relations:
        relations[r.name] = replace(r, patterns=tuple(dict.fromkeys((*relations[r.name].patterns, *r.patterns)))) if r.name in relations else r
    left = tuple(replace(r, patterns=tuple(p for p in r.patterns if set(p) <= set(kept))) for r in relations.values())
    return GraphSchema(child.name, tuple(kept.values()), tuple(r for r in left if r.patterns), child.version)


def patch_from(schema: GraphSchema, approved: list[dict]) -> dict:
    """What approved candidates (kind, label / source, type, target / property) add to a schema, in order of appearance."""
    out: dict[str, list] = {"entities": [], "relations": [], "properties": []}
    for c in approved:
        if c["kind"] == "entity" and c["label"] not in schema._by and c["label"] not in out["entities"]:
            out["entities"].append(c["label"])
        elif c["kind"] == "relation" and not schema.allows(c["source"], c["type"], c["target"]) and (row := [c["source"], c["type"], c["target"]]) not in out["relations"]:
            out["relations"].append(row)
        elif c["kind"] == "property" and (c["label"] not in schema._by or c["property"] not in schema.properties(c["label"])) and (row := [c["label"], c["property"]]) not in out["properties"]:
            out["properties"].append(row)
    return out


def write_patch(patch: dict, path: Path, overwrite: bool = False) -> Path:
    with open(path, "w" if overwrite else "x", encoding="utf-8") as f:
        json.dump(patch, f, indent=1, sort_keys=True)
    return path


def read_patch(path: Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


_JSON = {"string": {"type": "string"}, "integer": {"type": "integer"}, "float": {"type": "number"}, "boolean": {"type": "boolean"}, "date": {"type": "string", "format": "date"}}
_XSD = {"string": "xsd:string", "integer": "xsd:integer", "float": "xsd:double", "boolean": "xsd:boolean", "date": "xsd:date"}


def to_json_schema(schema: GraphSchema) -> dict:
    of = lambda e: {"type": "object", "properties": {p.name: _JSON[p.type] | ({"enum": list(p.enum)} if p.enum else {}) for p in schema.properties(e.label).values()}, "required": [p.name for p in schema.properties(e.label).values() if p.required]}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": schema.name, "$defs": {e.label: of(e) for e in schema.entities}}


def to_jsonld(schema: GraphSchema, base: str) -> dict:
    graph = [{"@id": base + e.label, "@type": "rdfs:Class", "rdfs:subClassOf": [{"@id": base + p} for p in e.parents]} for e in schema.entities]
    graph += [{"@id": base + r.name, "@type": "rdf:Property", "rdfs:domain": sorted({a for a, _ in r.patterns}), "rdfs:range": sorted({b for _, b in r.patterns})} for r in schema.relations]
    return {"@context": {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#"}, "@graph": graph}


def to_shacl(schema: GraphSchema, base: str) -> str:
    lines = ["@prefix sh: <http://www.w3.org/ns/shacl#> .", "@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .", f"@prefix g: <{base}> ."]
    for e in schema.entities:
        rows = [f"  sh:property [ sh:path g:{p.name} ; sh:datatype {_XSD[p.type]}" + (" ; sh:minCount 1" if p.required else "") + " ]" for p in schema.properties(e.label).values()]
        lines.append(" ;\n".join([f"g:{e.label}Shape a sh:NodeShape ;\n  sh:targetClass g:{e.label}", *rows]) + " .")
    return "\n\n".join(lines) + "\n"


DEFAULT = load(
    {
        "name": "default",
        "entities": [{"label": "Agent"}, {"label": "Person", "parents": ["Agent"]}, {"label": "Organization", "parents": ["Agent"]}, {"label": "Location"}, {"label": "Product"}, {"label": "Occasion"}, {"label": "Concept"}],
        "relations": [{"name": "WORKS_FOR", "patterns": [["Person", "Organization"]]}, {"name": "LOCATED_IN", "patterns": [["Agent", "Location"], ["Location", "Location"]]}, {"name": "MAKES", "patterns": [["Organization", "Product"]]}, {"name": "RELATED_TO", "patterns": [["Concept", "Concept"]], "symmetric": True}],
    }
)
