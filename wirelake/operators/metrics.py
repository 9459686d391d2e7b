"""Metrics of round trips: unpivoting, counters, gauges, histograms, expiry, rates and quantiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of histogram buckets.
BYTE_BOUNDS = tuple(k * 1024 for k in (10, 100, 250, 500)) + tuple(k * 1024 * 1024 for k in (1, 5, 10, 20, 30, 50, 80, 100, 150, 200, 500))
SECOND_BOUNDS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 30.0, 60.0, 120.0, 300.0, 600.0)
BOUNDS = {"bytes": BYTE_BOUNDS, "seconds": SECOND_BOUNDS, "": ()}

#: Labels that each protocol's metrics carry, with the field they come from.
LABELS = {
    "http": {"method": "request.method", "path": "request.path", "remote_host": "request.remote_host", "status_code": "response.status_code"},
    "http2": {"method": "request.method", "path": "request.path", "status_code": "response.status_code"},
    "grpc": {"service": "request.service", "status_code": "response.status_code"},
    "dns": {"question": "request.question"},
    "redis": {"command": "request.command"},
    "mysql": {"command": "request.command"},
    "postgresql": {"command": "request.command"},
    "mongodb": {"service": "request.command", "source": "request.source", "ok": "response.ok"},
    "kafka": {"api": "request.api", "version": "request.version"},
    "amqp": {"queue_name": "request.queue_name", "class": "request.class", "method": "request.method"},
}
#: Metrics that some protocols have besides the common ones, with model, unit and field; a round trip without the field has none.
EXTRA = {
    "mysql": (("mysql_response_affected_rows", "counter", "", "affected_rows"), ("mysql_response_resultset_rows", "histogram", "bytes", "returned_rows")),
    "postgresql": (("postgresql_response_affected_rows", "counter", "", "affected_rows"),),
}
#: Labels that every protocol may carry.
COMMON_LABELS = {"client.address": "client_address", "client.port": "client_port", "server.address": "server_address", "server.port": "server_port"}


def labels(pairs: Sequence[tuple[str, Column]]) -> Column:
    """Ordered labels; series are grouped by the array itself, so different labels never meet by a hash."""
    return F.array(*[F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in pairs])


def unpivot(trips: DataFrame, proto: str, label_array: Column, secs: Column, req_bytes: Column, rsp_bytes: Column, extra: Sequence[tuple[str, str, str, Column]] = ()) -> DataFrame:
    """(ts, name, model, unit, labels, value): a row for each metric of each round trip; null values of ``extra`` metrics say nothing."""
    rows = [
        (f"{proto}_requests_total", "counter", "", F.lit(1.0)),
        (f"{proto}_request_duration_seconds", "histogram", "seconds", secs),
        (f"{proto}_request_body_bytes", "histogram", "bytes", req_bytes),
        (f"{proto}_response_body_bytes", "histogram", "bytes", rsp_bytes),
        *extra,
    ]
    items = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("model"), F.lit(u).alias("unit"), v.cast("double").alias("value")) for n, m, u, v in rows])
    return trips.select("ts", label_array.alias("labels"), F.inline(items)).where("value IS NOT NULL").select("ts", "name", "model", "unit", "labels", "value")


def of_protocol(trips: DataFrame, proto: str, required: Sequence[str]) -> DataFrame:
    """The metrics of round trips of a protocol, from columns named after the fields in ``LABELS`` and ``EXTRA``, and secs, req_bytes and rsp_bytes. ``required`` are the labels
    that the configuration asks for, such as client.address or request.command; those of other protocols say nothing."""
    fields = COMMON_LABELS | {source: name for name, source in LABELS[proto].items()}
    pairs = [(fields[r], F.col(r.split(".")[-1] if r not in COMMON_LABELS else COMMON_LABELS[r])) for r in required if r in fields]
    extra = [(n, m, u, F.col(c)) for n, m, u, c in EXTRA.get(proto, ()) if c in trips.columns]
    return unpivot(trips, proto, labels(pairs), F.col("secs"), F.col("req_bytes"), F.col("rsp_bytes"), extra)


def dispatch(metrics: DataFrame, by: Sequence[str], log: bool = False) -> DataFrame:
    """(by, part, value) of mixed metrics by their model: sums of counters and the last write of gauges (part is null), counts of histograms by bucket, whose bounds are
    logarithmic with ``log`` and else those of the metric's unit (without a unit all values are in the one bucket that has no bound), cumulative."""
    keys = ["name", *by]
    plain = [F.lit(None).cast("string").alias("part"), F.col("value").cast("double").alias("value")]
    out = counter(metrics.where("model = 'counter'"), keys).select(*keys, *plain)
    out = out.unionByName(gauge(metrics.where("model = 'gauge'"), keys, ["ts", "value"]).select(*keys, *plain))
    seen = metrics.where("model = 'histogram'")
    if log:
        return out.unionByName(log_histogram(seen, keys, "value").select(*keys, F.col("vmrange").alias("part"), F.col("count").cast("double").alias("value")))
    for unit in BOUNDS:
        h = histogram(seen.where(F.col("unit") == unit), keys, "value", unit)
        out = out.unionByName(h.select(*keys, F.col("le").alias("part"), F.col("count").cast("double").alias("value")))
    return out


def counter(metrics: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    return metrics.groupBy(*by).agg(F.sum(value).alias("value"))


def gauge(metrics: DataFrame, by: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """The last write."""
    return metrics.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias("value"))


def bound_text(bound: float) -> str:
    return "+Inf" if math.isinf(bound) else f"{bound:.10g}"


def histogram(metrics: DataFrame, by: Sequence[str], value: str, unit: str) -> DataFrame:
    """(by, le, count, total, sum): cumulative counts of values up to each bound. All bounds come from one aggregate; only its few results are unpivoted."""
    bounds = [*BOUNDS[unit], math.inf]
    agg = metrics.groupBy(*by).agg(F.count(value).alias("total"), F.sum(value).alias("sum"), *[F.count_if(F.col(value) <= b).alias(f"_b{k}") for k, b in enumerate(bounds[:-1])])
    items = F.array(*[F.struct(F.lit(bound_text(b)).alias("le"), (F.col(f"_b{k}") if not math.isinf(b) else F.col("total")).alias("count")) for k, b in enumerate(bounds)])
    return agg.select(*by, F.inline(items), "total", "sum")


#: Logarithmic buckets: 18 to a power of ten, from 1e-9 to 1e18.
DECIMAL_LOW, DECIMAL_HIGH, PER_DECIMAL = -9, 18, 18
LOG_BUCKETS = (DECIMAL_HIGH - DECIMAL_LOW) * PER_DECIMAL
LOWEST, HIGHEST = "0...1.000e-09", "1.000e+18...+Inf"


def log_edge(bucket: float) -> float:
    """Where a bucket begins."""
    return 10.0 ** (DECIMAL_LOW + bucket / PER_DECIMAL)


def log_ranges() -> list[str]:
    """Names of the buckets."""
    return [f"{log_edge(k):.3e}...{log_edge(k + 1):.3e}" for k in range(LOG_BUCKETS)]


def log_quantile(buckets: DataFrame, by: Sequence[str], q: float) -> DataFrame:
    """(by, value) from logarithmic buckets (by, bucket, count): linear within the first that reaches q of the total. What is below the lowest edge lies between 0 and it, what is
    beyond the highest at that."""
    w = Window.partitionBy(*by)
    df = buckets.withColumns({"_upto": F.sum("count").over(w.orderBy("bucket")), "_total": F.sum("count").over(w)})
    rank = F.lit(q) * F.col("_total")
    hit = df.where((F.col("_upto") >= rank) & (F.col("_upto") - F.col("count") < rank))
    edge = lambda c: F.pow(F.lit(10.0), F.lit(float(DECIMAL_LOW)) + c / PER_DECIMAL)
    low = F.when(F.col("bucket") < 0, 0.0).otherwise(edge(F.col("bucket")))
    part = (rank - (F.col("_upto") - F.col("count"))) / F.col("count")
    value = F.when(F.col("bucket") >= LOG_BUCKETS, edge(F.lit(float(LOG_BUCKETS)))).otherwise(low + (edge(F.col("bucket") + 1) - low) * part)
    return hit.select(*by, value.alias("value"))


def log_bucket(value: Column) -> Column:
    """Number of the bucket: -1 below 1e-9 and for zero, LOG_BUCKETS from 1e18 on; null for what does not count. A value on an edge belongs to the bucket below it."""
    at = (F.log10(value) - DECIMAL_LOW) * PER_DECIMAL
    low = F.floor(at)
    inner = F.when((at == low) & (low > 0), low - 1).otherwise(low)
    return F.when(value.isNull() | F.isnan(value) | (value < 0), None).when(value == 0, -1).when(at < 0, -1).when(at >= LOG_BUCKETS, LOG_BUCKETS).otherwise(inner).cast("int")


def log_histogram(metrics: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, vmrange, count) of buckets that hold something, not cumulative."""
    names = F.array(*map(F.lit, log_ranges()))
    counts = metrics.withColumn("_b", log_bucket(F.col(value).cast("double"))).where("_b IS NOT NULL").groupBy(*by, "_b").agg(F.count("*").alias("count"))
    name = F.when(F.col("_b") < 0, LOWEST).when(F.col("_b") >= LOG_BUCKETS, HIGHEST).otherwise(F.get(names, F.col("_b")))
    return counts.select(*by, name.alias("vmrange"), "count", F.col("_b").alias("bucket"))


def expire(rows: DataFrame, by: Sequence[str], ts: str, seconds: int = 300) -> DataFrame:
    """(by, session, first_ts, last_ts, value): a series that was silent for longer than ``seconds`` begins anew at 0. Exactly that long keeps it."""
    from .l4 import idle_epochs

    marked = idle_epochs(rows, by, ts, [ts], seconds)
    return marked.groupBy(*by, F.col("epoch").alias("session")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("value"))


def rate(rows: DataFrame, by: Sequence[str], ts: str, window: str = "1 minute", seconds: int = 60) -> DataFrame:
    """Events a second in each window, from the events themselves, so that no counter reset matters."""
    return rows.groupBy(F.window(ts, window).alias("_w"), *by).agg((F.count("*") / seconds).alias("rate")).select(F.col("_w.start").alias("window_start"), *by, "rate")


def quantile(buckets: DataFrame, by: Sequence[str], q: float, bounds: Sequence[float]) -> DataFrame:
    """(by, value) from (by, le, count) with cumulative counts: linear within the first bucket that reaches q of the total; the last finite bound beyond."""
    upper = F.create_map(*[F.lit(x) for b in bounds for x in (bound_text(b), float(b))])
    w = Window.partitionBy(*by).orderBy("_le")
    df = buckets.withColumn("_le", F.coalesce(upper[F.col("le")], F.lit(math.inf)))
    df = df.withColumns({"_below": F.coalesce(F.lag("count").over(w), F.lit(0)), "_from": F.coalesce(F.lag("_le").over(w), F.lit(0.0)), "_total": F.max("count").over(Window.partitionBy(*by))})
    rank = F.lit(q) * F.col("_total")
    hit = df.where((F.col("count") >= rank) & ((F.col("_below") < rank) | ((F.col("_below") == 0) & (rank == 0))) & (F.col("_total") > 0))
    inside = F.col("_from") + (F.col("_le") - F.col("_from")) * ((rank - F.col("_below")) / (F.col("count") - F.col("_below")))
    value = F.when(F.col("_le") == math.inf, F.col("_from")).otherwise(inside)
    return hit.groupBy(*by).agg(F.min(value).alias("value"))


def prometheus_line(name: Column, label_array: Column, value: Column) -> Column:
    """``name{k="v",…} value`` with six decimals; values of labels are written as they are."""
    each = F.transform(label_array, lambda x: F.concat(x["name"], F.lit('="'), F.coalesce(x["value"], F.lit("")), F.lit('"')))
    inner = F.array_join(each, ",")
    return F.concat(name, F.when(F.size(label_array) > 0, F.concat(F.lit("{"), inner, F.lit("}"))).otherwise(""), F.lit(" "), F.format_string("%.6f", value.cast("double")))


def remote_write_series(series: DataFrame, now_seconds: Column) -> DataFrame:
    """(labels, sample_value, sample_ms): the name as first label, one sample at whole seconds."""
    named = F.concat(F.array(F.struct(F.lit("__name__").alias("name"), F.col("name").alias("value"))), F.col("labels"))
    return series.select(named.alias("labels"), F.col("value").alias("sample_value"), (now_seconds.cast("long") * 1000).alias("sample_ms"))
