"""Counters, gauges and cumulative histograms, and the text form that exposes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default upper bounds of latencies, in seconds.
LATENCY_BOUNDS = [0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def counters(rows: DataFrame, labels: list[str]) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("n"))


def gauges(rows: DataFrame, labels: list[str], value: str, at: str) -> DataFrame:
    """The last value set for each label tuple."""
    return rows.groupBy(*labels).agg(F.max_by(value, at).alias("value"))


def gauge_values(rows: DataFrame, labels: list[str], op: str = "op", value: str = "value", at: str = "at") -> DataFrame:
    """``labels, value`` after operations on gauges: ``set``, ``add`` and ``sub``. A gauge is what it was last set to and
    all that was added or taken since; one that was never set begins at 0. Two aggregations, combined in each task."""
    last = rows.where(F.col(op) == "set").groupBy(*labels).agg(F.max(F.struct(F.col(at).alias("at"), F.col(value).alias("v"))).alias("s"))
    change = F.when(F.col(op) == "add", F.col(value)).when(F.col(op) == "sub", -F.col(value))
    last = last.select(*(F.col(k).alias(f"_{k}") for k in labels), "s")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in labels]
    both = rows.join(last, same, "left") if labels else rows.join(F.broadcast(last), how="left")  # one row
    since = F.when(F.col("s").isNull() | (F.col(at) > F.col("s.at")), change)
    return both.groupBy(*labels).agg((F.coalesce(F.max("s.v"), F.lit(0)) + F.coalesce(F.sum(since), F.lit(0))).alias("value"))


def bound_text(b: float) -> str:
    return f"{b:g}"


def histogram(rows: DataFrame, labels: list[str], value: Column, bounds: list[float] | None = None) -> DataFrame:
    """``labels, le, n, sum, count``: cumulative counts for each bound, in ascending order, and ``+Inf``, with the sum and
    the number of a series' values on each of its rows; from one aggregation over the rows. Null values are not counted."""
    bounds = sorted(bounds or LATENCY_BOUNDS)
    counts = rows.groupBy(*labels).agg(*(F.count_if(value <= b).alias(f"b{k}") for k, b in enumerate(bounds)), F.count(value).alias("all"), F.sum(value).alias("sum"))
    parts = [F.struct(F.lit(bound_text(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)]
    return counts.select(*labels, F.inline(F.array(*parts, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))), F.coalesce("sum", F.lit(0)).alias("sum"), F.col("all").alias("count"))


def observe_requests(requests: DataFrame, seconds: Column, bounds: list[float] | None = None) -> tuple[DataFrame, DataFrame]:
    """The counter by op and result and the latency histogram by op of requests (op, result, ...)."""
    return counters(requests, ["op", "result"]), histogram(requests, ["op"], seconds, bounds)


def escape_label(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def sample_line(name: Column, labels: list[tuple[str, Column]], value: Column) -> Column:
    """One line of the text form; a null label is left out."""
    if not labels:
        return F.concat_ws(" ", name, value)
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{k}="'), escape_label(v), F.lit('"')) for k, v in labels))
    return F.concat(name, F.lit("{"), pairs, F.lit("} "), value)


def number_text(value: Column) -> Column:
    """A number in its shortest form, whole numbers without a point."""
    v = value.cast("double")
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("bigint").cast("string")).otherwise(v.cast("string"))


def family(body: DataFrame, name: str, help_: str, kind: str) -> DataFrame:
    """``line_no, line`` of a family from its lines as arrays of (order, lines): a row for each series, which are few."""
    head = [f"# HELP {name} " + help_.replace("\\", "\\\\").replace("\n", "\\n"), f"# TYPE {name} {kind}"]
    lines = body.groupBy().agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("order", "lines"))), lambda x: x["lines"])).alias("lines"))
    return lines.select(F.posexplode(F.concat(F.array(*map(F.lit, head)), "lines")).alias("line_no", "line"))


def histogram_exposition(series: DataFrame, name: str, help_: str, labels: list[str], bounds: list[float] | None = None) -> DataFrame:
    """``line_no, line``: a `histogram` (labels, le, n, sum, count) in text, for each series its buckets, sum and count."""
    order = F.create_map(*(x for k, b in enumerate([*sorted(bounds or LATENCY_BOUNDS), None]) for x in (F.lit("+Inf" if b is None else bound_text(b)), F.lit(k))))
    own = [(k, F.col(k)) for k in labels]
    bucket = sample_line(F.lit(f"{name}_bucket"), [*own, ("le", F.col("le"))], F.col("n").cast("string"))
    rows = series.groupBy(*labels).agg(F.array_sort(F.collect_list(F.struct(order[F.col("le")].alias("k"), bucket.alias("line")))).alias("b"), F.first("sum").alias("sum"), F.first("count").alias("count"))
    ends = F.array(sample_line(F.lit(f"{name}_sum"), own, number_text(F.col("sum"))), sample_line(F.lit(f"{name}_count"), own, F.col("count").cast("string")))
    key = F.struct(*(F.col(k) for k in labels)) if labels else F.struct(F.lit(0).alias("one"))
    return family(rows.select(key.alias("order"), F.concat(F.transform("b", lambda x: x["line"]), ends).alias("lines")), name, help_, "histogram")


class Registry:
    """Families of metrics by name, for one exposition. A name can be registered once, and rows need all labels."""

    def __init__(self) -> None:
        self.families: dict[str, tuple[str, str, list[str]]] = {}

    def register(self, name: str, help_: str, kind: str, labels: list[str]) -> None:
        if name in self.families:
            raise ValueError(f"{name} is registered already")
        if kind not in ("counter", "gauge", "histogram"):
            raise ValueError(f"{kind} is no kind of metric")
        self.families[name] = (help_, kind, list(labels))

    def expose(self, values: dict[str, DataFrame], bounds: list[float] | None = None) -> DataFrame:
        """``line_no, line`` of all families that have values, in the order of their registration."""
        out = None
        for place, (name, (help_, kind, labels)) in enumerate(self.families.items()):
            if name not in values:
                continue
            missing = set(labels) - set(values[name].columns)
            if missing:
                raise ValueError(f"{name} lacks the labels {sorted(missing)}")
            lines = histogram_exposition(values[name], name, help_, labels, bounds) if kind == "histogram" else exposition(values[name], name, help_, kind, labels)
            lines = lines.select(F.lit(place).alias("family"), "line_no", "line")
            out = lines if out is None else out.unionByName(lines)
        if out is None:
            raise ValueError("no family has values")
        # As many lines as series: few, so they can be numbered together.
        body = out.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("family", "line_no", "line"))), lambda x: x["line"]).alias("lines"))
        return body.select(F.posexplode("lines").alias("line_no", "line"))


def exposition(counts: DataFrame, name: str, help_: str, kind: str, labels: list[str]) -> DataFrame:
    """``line_no, line``: a family of counters or gauges (labels, n) in text, series in the order of their labels."""
    head = [f"# HELP {name} " + help_.replace("\\", "\\\\").replace("\n", "\\n"), f"# TYPE {name} {kind}"]
    line = sample_line(F.lit(name), [(k, F.col(k)) for k in labels], F.col("n").cast("string"))
    # A family has as many rows as label tuples, which metrics keep few.
    body = counts.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct(*labels, line.alias("line")))), lambda x: x["line"]).alias("lines"))
    return body.select(F.posexplode(F.concat(F.array(*map(F.lit, head)), "lines")).alias("line_no", "line"))
