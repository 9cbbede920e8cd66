"""One call from a source to cleaned data, profile, chart data and report."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablelens.config import DEFAULT, LensConfig
from tablelens.operators import chart_data as cd
from tablelens.operators import profiling
from tablelens.operators.cleaning import clean
from tablelens.operators.column_stats import pinned_stats
from tablelens.plans import catalogue, report, specs
from tablelens.sources.tables import RAW_VIEW, read_table, register


@dataclass
class Chart:
    title: str
    data: DataFrame
    source: str            # "llm" for charts from specs, "fallback" for rule-based ones
    explanation: str = ""


@dataclass
class Dashboard:
    charts: list[Chart]
    cleaned: DataFrame
    report: DataFrame
    explanation: DataFrame
    columns: DataFrame
    summary: DataFrame
    warnings: DataFrame
    errors: list[str] = field(default_factory=list)

    def previews(self) -> list[tuple[str, DataFrame]]:
        """Title and preview of each spec's result, as a writer of insights reads them; made when asked for."""
        return [(c.title, specs.result_preview(c.data)) for c in self.charts if c.source == "llm"]


def admitted(spark: SparkSession, chart_specs: list[dict], cfg: LensConfig = DEFAULT) -> tuple[list[dict], list[str]]:
    """The specs that pass the field, SQL and cross rules, and an error text for each other one; none if their number is wrong."""
    if not cfg.min_specs <= len(chart_specs) <= cfg.max_specs:
        return [], [f"{len(chart_specs)} charts were asked for; {cfg.min_specs} to {cfg.max_specs} are allowed"]
    names = [f.name for f in StructType.fromDDL(specs.SPEC_SCHEMA)]
    rows = spark.createDataFrame([tuple(s.get(n) for n in names) for s in chart_specs], specs.SPEC_SCHEMA)
    found = [r["violations"] for r in specs.validate_specs(rows).select("violations").collect()]
    errors = [f"Chart '{s['title']}' is not valid: {', '.join(v)}" for s, v in zip(chart_specs, found) if v]
    return [s for s, v in zip(chart_specs, found) if not v], errors


def _pairs(table: DataFrame, columns: DataFrame, cfg: LensConfig) -> DataFrame | None:
    numeric = [r["column"] for r in columns.where("semantic_type = 'numeric'").orderBy("ord").select("column").collect()]
    return cd.correlations(table, list(combinations(numeric, 2)), cfg=cfg) if len(numeric) > 1 else None


def build_dashboard(spark: SparkSession, source: str | DataFrame, chart_specs: list[dict] | None = None,
                    cfg: LensConfig = DEFAULT, **read_options) -> Dashboard:
    """Load, clean, profile, chart and explain. Only a load error stops it; a refused or failing spec becomes an error text.

    Without specs the fixed planning rules provide them. The data of a chart is a frame that is run when it is read; bounds of bins
    and spans of dates are looked up when a chart is built.
    """
    raw = register(read_table(spark, source, **read_options), RAW_VIEW)
    cleaned = clean(raw, cfg)
    table = cleaned.register()
    stats = pinned_stats(table, cfg, outlier_k=cfg.profile_iqr)
    columns = profiling.column_profile(stats, cfg)
    if chart_specs is None:
        planned = specs.plan_specs(columns, _pairs(table, columns, cfg), cfg=cfg)
        chart_specs, refused = [r.asDict() for r in planned.orderBy("pos").collect()], []
    else:
        chart_specs, refused = admitted(spark, chart_specs, cfg)
    results, errors = specs.run_specs(spark, chart_specs)
    errors = refused + errors
    charts = [Chart(s["title"], d, "llm", s.get("plain_language_explanation") or "") for s, d in results]
    if len(charts) < cfg.min_specs:
        rows = catalogue.chart_catalogue(table, stats, cfg=cfg).collect()
        charts += [Chart(r["title"], catalogue.chart_frame(table, r, stats, cfg), "fallback") for r in rows]
    return Dashboard(charts, table, cleaned.report, report.bundle(cleaned.report),
                     columns.join(F.broadcast(profiling.sample_values(table, stats, cfg)), "column", "left"),
                     profiling.table_summary(table, cfg), profiling.warnings(stats, cfg), errors)
