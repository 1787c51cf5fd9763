"""Facts: declarative rules or slopes over flat views, as nested rows.

A rule's condition, severity and confidence are Columns; facts are made by one
select (detail) or one aggregate (whole view), never by a loop over rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iolens import schema as S
from iolens.functions import expressions as E
from iolens.functions.metrics import severity_label, slope_severity
from iolens.rulepacks import PACKS

# Names and versions that facts carry.
FACT_VERSION = "analysisfact.v1"
ENVELOPE_VERSION = "analyzer.fact-envelope.v1"
SLOPE_FLOOR = 0.30
TOP_K = 5


@dataclass(frozen=True)
class Rule:
    id: str
    fact_type: str
    when: str
    severity_score: str
    view_types: tuple[str, ...] = ()
    scope_layer: str | None = None
    required_metrics: tuple[str, ...] = ()
    derived_metrics: dict[str, str] = field(default_factory=dict)
    confidence: str | float | None = None
    emit_mode: str | None = None
    opportunity_tags: tuple[str, ...] = ()
    suppresses_tags: tuple[str, ...] = ()
    priority: int = 0
    rule_version: str = "v1"
    allow_mixed: bool = False

    def matches(self, view_type: str) -> bool:
        return not self.view_types or view_type in self.view_types


def build_rule(d: dict, defaults: dict | None = None, strict: bool = True) -> Rule:
    """A rule from its mapping; source_view stands for one view type; sums and maxima of time may not mix in strict mode."""
    d = dict(defaults or {}) | d
    views = d.get("view_types") or ([d["source_view"]] if d.get("source_view") else [])
    mode = d.get("emit_mode")
    if mode not in (None, "detail", "aggregate"):
        raise ValueError(f"rule {d.get('id')}: emit_mode {mode!r}")
    rule = Rule(
        str(d["id"]), d["fact_type"], str(d["when"]), str(d["severity_score"]), tuple(views), d.get("scope_layer"), tuple(d.get("required_metrics") or ()),
        {k: str(v) for k, v in (d.get("derived_metrics") or {}).items()}, d.get("confidence"), mode, tuple(d.get("opportunity_tags") or ()),
        tuple(d.get("suppresses_tags") or ()), int(d.get("priority", 0)), str(d.get("rule_version", "v1")), bool(d.get("allow_mixed", False)),
    )
    if strict and not rule.allow_mixed:
        for text in [*rule.derived_metrics.values(), rule.when, rule.severity_score]:
            if E.mixes_time_aggregates(text):
                raise ValueError(f"rule {rule.id} mixes sums and maxima of time: {text}")
    return rule


def load_rules(name: str, strict: bool = True) -> list[Rule]:
    """Rules of a YAML or JSON file (a path, with or without suffix, or a packaged file) or of a named pack; highest priority first."""
    own = Path(__file__).parent / "packs"
    for base in (Path(name), own / name):
        for path in (base, base.with_name(base.name + ".yaml"), base.with_name(base.name + ".yml"), base.with_name(base.name + ".json")):
            if path.is_file():
                text = path.read_text()
                if path.suffix == ".json":
                    data = json.loads(text)
                else:
                    import yaml

                    data = yaml.safe_load(text)
                rules = [build_rule(r, data.get("defaults"), strict) for r in data["rules"]]
                return sorted(rules, key=lambda r: -r.priority)
    if name in PACKS:
        return sorted((build_rule(r, strict=strict) for r in PACKS[name]), key=lambda r: -r.priority)
    raise FileNotFoundError(name)


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def fact_id(fact_type: Column, window: dict[str, Column], scope: dict[str, Column]) -> Column:
    """af_ and 12 hex digits over type, window and scope; missing parts print as None."""
    parts = [F.lit(FACT_VERSION), fact_type, *[window[k] for k in ("run_id", "view_type", "epoch", "step", "t0_ns", "t1_ns")], *[scope[k] for k in ("layer", "entity", "rank_set")]]
    return F.concat(F.lit("af_"), F.substring(F.md5(F.concat_ws(":", *[_text(p) for p in parts])), 1, 12))


def _facts(rows: DataFrame, rule: Rule, view_type: str, view_key: list[str], run_id, trigger: str, method: str, source: str, window, scope, metrics, top_k=None) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    window = {"run_id": F.lit(run_id).cast("string"), "view_type": F.lit(view_type), "window_index": null("bigint"), "epoch": null("bigint"), "step": null("bigint"), "time_bucket": null("bigint"), "t0_ns": null("bigint"), "t1_ns": null("bigint"), "trigger": F.lit(trigger)} | window
    scope = {"workload": null("string"), "layer": F.lit(rule.scope_layer).cast("string"), "entity": null("string"), "rank_set": F.lit("all"), "node": null("string")} | scope
    struct = lambda d: F.struct(*[c.alias(k) for k, c in d.items()])
    tags = lambda t: F.array(*map(F.lit, t)).cast("array<string>")
    top_k = top_k if top_k is not None else F.lit(None).cast("array<struct<entity:string,severity:double,metrics:map<string,double>>>")
    return rows.select(
        F.lit(FACT_VERSION).alias("schema_version"),
        fact_id(F.lit(rule.fact_type), window, scope).alias("fact_id"),
        F.lit(rule.fact_type).alias("fact_type"),
        struct(window).alias("window"),
        struct(scope).alias("scope"),
        F.struct(metrics.alias("metrics"), top_k.alias("top_k")).alias("evidence"),
        F.struct(F.col("_sev").alias("score"), severity_label(F.col("_sev")).alias("label"), F.lit(method).alias("method")).alias("severity"),
        F.col("_conf").alias("confidence"),
        tags(rule.opportunity_tags).alias("opportunity_tags"),
        tags(rule.suppresses_tags).alias("suppresses_tags"),
        F.struct(F.lit(rule.id).alias("rule_id"), F.lit(rule.rule_version).alias("rule_version"), F.lit(source).alias("metric_source"), tags(view_key).alias("view_key")).alias("provenance"),
    )


def _emit(rows: DataFrame, hit: Column, rule: Rule, mode: str, view_type: str, view_key: list[str], run_id, trigger, method, source, evidence: list[str], granularity: int | None) -> DataFrame:
    """rows hold _sev and _conf; hit tells which become facts."""
    metrics = F.create_map(*[x for m in evidence for x in (F.lit(m), F.col(f"`{m}`").cast("double"))]) if evidence else F.create_map().cast("map<string,double>")
    keep = lambda c, o: F.coalesce(c, F.lit(o))
    rows = rows.withColumns({"_sev": F.col("_sev").cast("double"), "_conf": keep(F.col("_conf").cast("double"), 1.0)})
    if mode == "aggregate" and view_type not in S.TEMPORAL_VIEWS:
        # the worst entities: an aggregate of bounded size per partition, then one row
        marked = rows.withColumn("_hit", keep(hit, False))
        worst = F.struct((-keep(F.col("_sev"), 0.0)).alias("o"), F.col(view_type).cast("string").alias("entity"), F.col("_sev").alias("severity"), metrics.alias("metrics"))
        head = marked.where("_hit").orderBy(F.desc_nulls_last("_sev"), F.col(view_type).cast("string")).limit(TOP_K).select(worst.alias("w"))
        top = head.agg(F.array_sort(F.collect_list("w"), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).when(a["entity"] < b["entity"], -1).otherwise(1)).alias("_w"), F.lit(1).alias("_one"))
        best = F.transform("_w", lambda x: F.struct(x["entity"].alias("entity"), x["severity"].alias("severity"), x["metrics"].alias("metrics")))
        one = marked.agg(F.count_if("_hit").alias("n"), F.count(F.lit(1)).alias("whole"), keep(F.max(F.when(F.col("_hit"), F.col("_sev"))), 0.0).alias("_sev"), keep(F.max(F.when(F.col("_hit"), F.col("_conf"))), 1.0).alias("_conf")).where("n > 0")
        one = one.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one")  # one row each
        sums = F.create_map(F.lit("affected_count"), F.col("n").cast("double"), F.lit("total_count"), F.col("whole").cast("double"), F.lit("affected_fraction"), F.col("n") / F.col("whole"))
        return _facts(one, rule, view_type, view_key, run_id, trigger, method, source, {}, {}, sums, best)
    rows = rows.where(keep(hit, False)).withColumn("_sev", keep(F.col("_sev"), 0.0))
    window, scope = {}, {}
    for axis in ("epoch", "step"):
        if axis in rows.columns:
            window[axis] = F.col(axis).cast("bigint")
    at = F.expr(f"try_cast({view_type} as bigint)")
    if view_type in S.TEMPORAL_VIEWS:
        rows = rows.where(at.isNotNull())
        window[{"window": "window_index", "time_range": "time_bucket"}.get(view_type, view_type)] = at
        if view_type == "time_range" and granularity:
            window |= {"t0_ns": at * (granularity * 1000), "t1_ns": (at + 1) * (granularity * 1000)}
    elif view_type in ("source_node", "host_hash"):
        scope = {"entity": F.lit(view_type), "node": F.col(view_type).cast("string")}
    else:
        scope = {"entity": F.col(view_type).cast("string")}
    return _facts(rows, rule, view_type, view_key, run_id, trigger, method, source, window, scope, metrics)


def rule_facts(view: DataFrame, view_key: list[str], rules: list[Rule], run_id: str | None = None, emit_mode: str = "aggregate", granularity: int | None = None, aggregates: str = "rowwise") -> DataFrame | None:
    """Facts of all rules that match the view; None where none applies.

    A rule is skipped if a required metric or a name it uses is missing, or a
    derived metric can't be compiled; an error in its condition is raised.
    Severity and confidence are clipped to [0, 1]; a null condition is false.
    granularity: bucket width in µs.
    """
    view_type = view_key[-1]
    extreme = lambda how, c: rows.agg((F.max if how == "max" else F.min)(c).alias("x")).scalar()
    out = []
    have = set(view.columns)
    for rule in rules:
        if not rule.matches(view_type) or not set(rule.required_metrics) <= have:
            continue
        texts = [rule.when, rule.severity_score, *([rule.confidence] if isinstance(rule.confidence, str) else [])]
        used = {n for t in [*texts, *rule.derived_metrics.values()] for n in E.identifiers(t)} | set(rule.required_metrics) | {"epoch", "step"}
        names = {view_type, *(used & have)}
        rows = view.select(*sorted(names))  # a wide view costs each rule its whole schema
        try:
            for name, text in rule.derived_metrics.items():
                rows = rows.withColumn(name, E.compile_expression(text, names, aggregates, extreme))
                names.add(name)
        except E.ExpressionError:
            continue
        if any(set(E.identifiers(t)) - names for t in texts):
            continue
        clip = lambda t, n=names: E.compile_expression(f"clip01({t})", n, aggregates, extreme)
        rows = rows.withColumns({"_sev": clip(rule.severity_score), "_conf": clip(str(rule.confidence)) if rule.confidence is not None else F.lit(None).cast("double")})
        hit = E.compile_expression(rule.when, names, aggregates, extreme)
        evidence = list(dict.fromkeys([*rule.required_metrics, *rule.derived_metrics]))
        out.append(_emit(rows, hit, rule, rule.emit_mode or emit_mode, view_type, view_key, run_id, "rule_eval", "rule_expr", "flat_view", evidence, granularity))
    return reduce(DataFrame.unionByName, out) if out else None


def slope_facts(view: DataFrame, view_key: list[str], layers: list[str], run_id: str | None = None, emit_mode: str = "aggregate", floor: float = SLOPE_FLOOR) -> DataFrame | None:
    """A fact for every *_ops_slope column with rows whose severity reaches the floor."""
    by_length = sorted(layers, key=len, reverse=True)
    out = []
    for c in sorted(x for x in view.columns if x.endswith("_ops_slope")):
        base = c.removesuffix("_ops_slope")
        layer = next((x for x in by_length if base == x or base.startswith(x + "_")), None)
        op = base[len(layer) :].lstrip("_") if layer else base
        rule = Rule("", f"{op}_slope" if op else c, "", "", scope_layer=layer, rule_version="metric")
        rows = view.withColumns({"_sev": slope_severity(F.col(c)), "_conf": F.lit(None).cast("double")})
        out.append(_emit(rows, F.col("_sev") >= floor, rule, emit_mode, view_key[-1], view_key, run_id, "metric_eval", "metric_slope", c, [c], None))
    return reduce(DataFrame.unionByName, out) if out else None


def summary(facts: DataFrame) -> DataFrame:
    """Per fact type and view: count, highest severity, its label, and all tags."""
    top = F.max_by("severity.label", "severity.score")
    return facts.groupBy("fact_type", F.col("window.view_type").alias("view_type")).agg(
        F.count(F.lit(1)).alias("n"), F.max("severity.score").alias("peak"), top.alias("label"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("opportunity_tags")))).alias("tags")
    )


def envelope_text(facts: DataFrame | None, context: dict) -> Iterator[str]:
    """The envelope of facts as pieces of one JSON text; one partition of facts is held at a time.

    The context gets window_type_counts, the facts per type of window.
    """
    by_view: dict[str, int] = {}
    yield f'{{"schema_version": {json.dumps(ENVELOPE_VERSION)}, "facts": ['
    rows = facts.select(F.col("window.view_type").alias("v"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator() if facts is not None else ()
    for i, r in enumerate(rows):
        by_view[r["v"]] = by_view.get(r["v"], 0) + 1
        yield f"{', ' * (i > 0)}{r['j']}"
    yield f'], "context": {json.dumps(context | {"window_type_counts": by_view})}, "fact_count_by_view": {json.dumps(by_view)}}}'


def envelope(facts: DataFrame | None, context: dict) -> dict:
    """envelope_text as a dict, for few facts."""
    return json.loads("".join(envelope_text(facts, context)))
