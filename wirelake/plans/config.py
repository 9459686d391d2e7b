"""Configuration of a pipeline: a nested dict, as from a YAML file, checked and turned into a plan. Unknown keys and processors are errors."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, metrics, spans


@dataclass(frozen=True)
class Settings:
    """``pipeline`` maps a name to processors; each processor takes the round trips themselves."""

    rules: list[filters.Rule] = field(default_factory=list)
    ip_version: str = ""
    expire_seconds: int = 300
    log_histogram: bool = False
    pipeline: dict[str, list[str]] = field(default_factory=dict)
    labels: list[str] = field(default_factory=list)


def load(data: Mapping) -> Settings:
    known = {f.name for f in fields(Settings)}
    if unknown := set(data) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    rules = [filters.Rule(**r) for r in data.get("rules", [])]
    for r in rules:
        r.transport  # noqa: B018  unknown protocols are errors here
    for name, steps in data.get("pipeline", {}).items():
        if not steps or (wrong := set(steps) - set(PROCESSORS)):
            raise ValueError(f"pipeline {name!r}: {'no processors' if not steps else f'unknown processors {sorted(wrong)}'}")
    if wrong := set(data.get("labels", [])) - set(metrics.COMMON_LABELS) - {x for own in metrics.LABELS.values() for x in own.values()}:
        raise ValueError(f"unknown labels: {sorted(wrong)}")
    return Settings(**{**data, "rules": rules})


def parse_rule(text: str) -> filters.Rule:
    """``protocol;port,port;host`` as a rule."""
    parts = [p.strip() for p in text.split(";")]
    if len(parts) < 2 or not parts[1]:
        raise ValueError(f"no ports in {text!r}")
    rule = filters.Rule(parts[0], tuple(int(p) for p in parts[1].split(",")), parts[2] if len(parts) > 2 else "")
    rule.transport  # noqa: B018
    return rule


#: Columns of round trips that hold what common labels ask for.
ADDRESSES = {"client_address": "client", "client_port": "client_port", "server_address": "server", "server_port": "server_port"}


def to_metrics(trips: DataFrame, s: Settings, proto: str = "http") -> DataFrame:
    """Metrics with the labels that the settings ask for; of HTTP, method and status besides."""
    trips = trips.withColumns({k: F.col(c) for k, c in ADDRESSES.items() if k not in trips.columns and c in trips.columns})
    if proto == "http":
        trips = trips.withColumn("status_code", F.col("status"))
    always = ["request.method", "response.status_code"] if proto == "http" else []
    return metrics.of_protocol(trips, proto, [*s.labels, *(x for x in always if x not in s.labels)])


def to_series(trips: DataFrame, s: Settings, proto: str = "http") -> DataFrame:
    """Those metrics gathered into series by their model; histograms with the buckets that the settings ask for."""
    return metrics.dispatch(to_metrics(trips, s, proto), ["labels"], s.log_histogram)


def to_spans(trips: DataFrame, s: Settings, proto: str = "http") -> DataFrame:
    return spans.http_span(trips) if proto == "http" else spans.span(trips, proto)


PROCESSORS = {"roundtripstometrics": to_metrics, "roundtripstotraces": to_spans}


def plan(trips: DataFrame, s: Settings, proto: str = "http") -> dict[tuple[str, str], DataFrame]:
    """A DataFrame for each pipeline and processor, over round trips of one protocol."""
    return {(name, step): PROCESSORS[step](trips, s, proto) for name, steps in s.pipeline.items() for step in steps}
