"""Declarative contracts and policy registries: loading, checks, dimension tables."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTERFACES, MODES = ("dataclass", "tuple", "dict", "struct"), ("A", "B", "C")


def read_document(text: str) -> dict:
    """YAML if the parser is there, else JSON."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


@dataclass(frozen=True)
class Variable:
    name: str
    detector: str
    criticality: int = 5
    mode: str = "A"
    interface: str = "struct"
    value_field: str = "value"
    status_field: str | None = None
    evidence_field: str | None = None
    certainty_field: str | None = None
    comparison_column: str | None = None
    ontology: tuple[str, ...] = ()
    silence: dict = field(default_factory=dict)
    canaries: tuple[dict, ...] = ()


@dataclass(frozen=True)
class Contract:
    id: str
    version: str
    corpus: dict
    variables: tuple[Variable, ...]
    output: dict
    raw: str

    @property
    def hash(self) -> str:
        return hashlib.sha256(self.raw.encode()).hexdigest()

    def variable(self, name: str) -> Variable:
        return {v.name: v for v in self.variables}[name]

    def columns(self) -> list[str]:
        """Columns a scan needs: id, text, strata, extra and comparison columns, each once."""
        c = self.corpus
        wanted = [c["id_column"], c["text_column"], *c.get("strata_columns", []), *c.get("extra_columns", []),
            *[v.comparison_column for v in self.variables if v.comparison_column]]
        return list(dict.fromkeys(wanted))

    def summary(self) -> str:
        lines = [f"{self.id} {self.version} ({self.hash[:12]})"] + [f"  {v.name}: mode {v.mode}, criticality {v.criticality} ({band(v.criticality)}), {len(v.canaries)} canaries" for v in self.variables]
        return "\n".join(lines)


def band(criticality: int) -> str:
    return "CRITICA" if criticality >= 7 else "ALTA" if criticality >= 5 else "MEDIA" if criticality >= 3 else "BAIXA"


def band_column(c: Column) -> Column:
    return F.when(c >= 7, "CRITICA").when(c >= 5, "ALTA").when(c >= 3, "MEDIA").otherwise("BAIXA")


def load_contract(text: str) -> Contract:
    """Contract from its text; the blocks contract, corpus and variables must stand in it."""
    d = read_document(text)
    missing = [k for k in ("contract", "corpus", "variables") if not d.get(k)]
    if missing:
        raise ValueError(f"contract lacks {', '.join(missing)}")
    variables = []
    for v in d["variables"]:
        det = v.get("detector") or {}
        det = {"function": det} if isinstance(det, str) else det
        variables.append(Variable(
            v["name"], det.get("function", v["name"]), int(v.get("criticality", 5)), v.get("mode", "A"),
            det.get("interface", "struct"), det.get("value_field", "value"), det.get("status_field"),
            det.get("evidence_field"),
            det.get("certainty_field"), v.get("comparison_column"), tuple(map(str, v.get("ontology_values", ()))),
            v.get("silence_policy") or {}, tuple(v.get("canaries") or ()),
        ))
    c = Contract(str(d["contract"].get("id")), str(d["contract"].get("version", "1.0.0")), dict(d["corpus"]),
        tuple(variables), dict(d.get("output") or {}), text)
    check_contract(c)
    return c


def check_contract(c: Contract) -> None:
    """Raise ValueError for what can't run."""
    names = [v.name for v in c.variables]
    bad = [f"variable {n} twice" for n in sorted({n for n in names if names.count(n) > 1})]
    for v in c.variables:
        if not 0 <= v.criticality <= 10:
            bad.append(f"{v.name}: criticality {v.criticality} not in 0-10")
        if v.interface not in INTERFACES:
            bad.append(f"{v.name}: unknown interface {v.interface}")
        if v.mode not in MODES:
            bad.append(f"{v.name}: unknown mode {v.mode}")
        if v.mode == "C" and not (v.evidence_field and v.certainty_field):
            bad.append(f"{v.name}: mode C needs evidence and certainty fields")
    for k in ("id_column", "text_column"):
        if not c.corpus.get(k):
            bad.append(f"corpus lacks {k}")
    if bad:
        raise ValueError("; ".join(bad))


def load_registry(text: str) -> list[dict]:
    """Policies from a registry's text: one dict per variable; a `range` block of min and max counts as bounds."""
    d = read_document(text)
    out = []
    for name, p in (d.get("policies") or {}).items():
        o = p.get("output_ontology") or p.get("ontology")
        if not o:
            raise ValueError(f"policy {name} lacks an ontology")
        r = o.get("range") or ([o["min"], o["max"]] if "min" in o and "max" in o else None)
        kind = "float" if o.get("type") == "range" else o.get("type", "string")
        out.append({
            "variable": name, "onto_type": kind, "vals": [str(x) for x in o.get("values") or []],
            "lo": float(r[0]) if r else None, "hi": float(r[1]) if r else None,
            "aliases": {str(k): str(v) for k, v in (p.get("vocabulary_aliases") or {}).items()},
            "default_if_silent": None if p.get("default_if_silent") is None else str(p["default_if_silent"]),
            "implicit_negative": bool(p.get("allows_implicit_negative", False)),
            "abstention_statuses": [str(x) for x in p.get("abstention_statuses") or []],
            "taxonomy": [str(x) for x in p.get("taxonomy") or []],
        })
    return out


def registry_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def policy_of(policies: list[dict], variable: str) -> dict | None:
    """The policy of a variable, None without one."""
    return next((p for p in policies if p["variable"] == variable), None)


REGISTRY = "variable string, onto_type string, vals array<string>, lo double, hi double, aliases map<string,string>, default_if_silent string, implicit_negative boolean, abstention_statuses array<string>, taxonomy array<string>"


def registry_table(spark: SparkSession, policies: list[dict]) -> DataFrame:
    names = [x.split()[0] for x in REGISTRY.split(", ")]
    return spark.createDataFrame([tuple(p[n] for n in names) for p in policies], REGISTRY)


def cross_check(variables: DataFrame, policies: DataFrame) -> DataFrame:
    """(variable, severity, message) of a contract against a registry.

    variables: (variable, criticality, ontology array); policies: (variable, onto_type, vals).
    """
    c = F.col
    x = variables.join(policies.withColumn("known", F.lit(True)), "variable", "left")
    same = F.array_sort(F.array_distinct(c("ontology"))) == F.array_sort(F.array_distinct(c("vals")))
    severity = (
        F.when(c("known").isNull() & (c("criticality") >= 7), "error").when(c("known").isNull() & (c("criticality") >= 5),
            "warning")
        .when((c("onto_type") == "enum") & (F.size("vals") == 0),
            "error").when((F.size("ontology") > 0) & c("known").isNotNull() & ~F.coalesce(same, F.lit(False)), "warning")
    )
    message = F.when(c("known").isNull(), "no policy").when((c("onto_type") == "enum") & (F.size("vals") == 0),
        "enum without values").otherwise("ontologies differ")
    return x.withColumn("severity", severity).where("severity IS NOT NULL").select("variable", "severity",
        message.alias("message"))
