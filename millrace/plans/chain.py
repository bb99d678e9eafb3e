"""Declared pipelines: a spec becomes one lazy chain of ``DataFrame.transform``."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, clean, dedup, enrich, filters, mapping, normalize, validate
from ..sources import readers, sinks

log = logging.getLogger(__name__)

OPERATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "normalize": mapping.normalize_keys,
    "deduplicate": dedup.dedup_rows,
    "drop_nulls": mapping.drop_nulls,
    "lowercase_keys": mapping.lowercase_keys,
    "strip_whitespace": mapping.strip_whitespace,
}


def apply_operations(df: DataFrame, names: list[str]) -> DataFrame:
    """Named operations in order; an unknown name is skipped with a warning."""
    for name in names:
        step = OPERATIONS.get(name)
        if step is None:
            log.warning("unknown operation %s is skipped", name)
        else:
            df = df.transform(step)
    return df


def _order(spec: dict) -> list[str]:
    if not spec.get("order_by"):
        raise ValueError("deduplication needs order_by: which row of a key is the first")
    return spec["order_by"]


TYPES: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "mapping": lambda df, s: mapping.map_fields(df, s["rules"]),
    "filtering": lambda df, s: filters.all_of(df, s["rules"]),
    "aggregation": lambda df, s: aggregate.aggregate(df, s.get("group_by", []), s["rules"]),
    "enrichment": lambda df, s: enrich.enrich(df, s["rules"]),
    "cleaning": lambda df, s: clean.clean(df, s["rules"]),
    "validation": lambda df, s: validate.validate(df, s["rules"]),
    "normalization": lambda df, s: normalize.normalize(df, s["rules"]),
    "deduplication": lambda df, s: dedup.dedup(df, s["rules"], _order(s)),
    "generic": lambda df, s: generic(df, s["rules"]),
    # Single-field steps, with their parameters beside the type.
    "add_field": lambda df, s: mapping.add_field(df, s["field_name"], s.get("field_value")),
    "rename_field": lambda df, s: mapping.rename_field(df, s["old_name"], s["new_name"]),
    "calculate_field": lambda df, s: mapping.calculate_field(df, s["field_name"], s.get("calculation", {})),
    "data_type_conversion": lambda df, s: mapping.convert_type(df, s["field_name"], s["target_type"]),
    "filter_condition": lambda df, s: df.filter(filters.typed_condition(
        df, s["condition"]["field"], s["condition"].get("operator", "equals"), s["condition"].get("value"))),
}
ALIASES = {"filter": "filtering", "field_mapping": "mapping"}


def typed(df: DataFrame, spec: dict) -> DataFrame:
    """One transformation by type name. A rule without ``rules`` is its own only rule."""
    name = ALIASES.get(spec["type"], spec["type"])
    if name not in TYPES:
        raise ValueError(f"unknown transformation {spec['type']!r}")
    if "rules" not in spec and name in ("mapping", "filtering"):
        spec = {**spec, "rules": [{k: v for k, v in spec.items() if k != "type"}]}
    return TYPES[name](df, spec)


def generic(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Rules of mixed type in order."""
    for rule in sorted((r for r in rules if r.get("enabled", True)), key=lambda r: r.get("order", 0)):
        df = df.transform(typed, rule)
    return df


def load_spec(text_or_dict: str | dict) -> dict:
    """YAML text or a dict; the stages may stand below ``pipeline``."""
    spec = text_or_dict
    if isinstance(spec, str):
        import yaml

        spec = yaml.safe_load(spec)
    return spec.get("pipeline", spec)


def _settings(stage: dict) -> tuple[str, str, dict]:
    """Name, role and settings; settings stand in ``config`` or beside the role."""
    beside = {k: v for k, v in stage.items() if k not in ("name", "role", "type", "config")}
    return stage.get("name", "unnamed-stage"), stage.get("role") or stage.get("type", "extractor"), {**beside, **stage.get("config", {})}


def _extract(spark: SparkSession, conf: dict, inputs: dict[str, DataFrame]) -> DataFrame:
    if "input" in conf:
        return inputs[conf["input"]]
    source = conf.get("source", conf.get("path"))
    if isinstance(source, list) or (isinstance(source, str) and "\n" in source):
        return readers.inline_source(spark, source)
    return readers.read_auto(spark, source)


def run(
    spark: SparkSession, spec: str | dict, inputs: dict[str, DataFrame] | None = None,
    handlers: dict[str, Callable[[DataFrame], DataFrame]] | None = None, metrics: dict[str, Observation] | None = None,
) -> DataFrame:
    """Stages extractor, transformer, loader, validator, each feeding the next.

    ``inputs`` are named frames for the first stage; a name in ``handlers``
    replaces that stage; ``metrics`` collects one row count per stage, filled
    when the result is first computed. The plan stays lazy up to a loader.
    """
    df = None
    for stage in load_spec(spec)["stages"]:
        name, role, conf = _settings(stage)
        if handlers and name in handlers:
            df = handlers[name](df)
        elif role == "extractor":
            df = _extract(spark, conf, inputs or {})
        elif role == "transformer":
            df = apply_operations(df, conf.get("operations", []))
            df = generic(df, conf.get("rules", []))
        elif role == "loader":
            target = conf["destination"]
            sinks.write_file(df, target, conf.get("format") or sinks.format_of(target))
        elif role == "validator":
            rules = conf.get("rules", conf)
            df = validate.required_share(df, rules["required_fields"], rules.get("max_null_pct", 20.0))
        else:
            raise ValueError(f"unknown role {role!r}")
        if metrics is not None and role != "loader":
            metrics[name] = Observation(name)
            df = df.observe(metrics[name], F.count(F.lit(1)).alias("records"))
    return df


def run_tables(spark: SparkSession, tables: dict[str, DataFrame], steps: Callable[[DataFrame], DataFrame], folder: str,
               format: str = "parquet") -> DataFrame:
    """The same chain for every table, each its own plan and target; one status row per table."""
    rows = []
    for name, df in tables.items():
        rows.append((name, sinks.write_file(df.transform(steps), f"{folder}/{sinks.check_identifier(name)}", format)))
    return spark.createDataFrame(rows, "table string, records long")
