"""tablelens: clean, profile and summarise any table with Spark."""

from tablelens.config import DEFAULT, LensConfig
from tablelens.operators.cleaning import clean
from tablelens.operators.column_stats import column_stats
from tablelens.operators.profiling import profile
from tablelens.plans.catalogue import chart_catalogue, chart_frame
from tablelens.plans.dashboard import build_dashboard
from tablelens.plans.report import bundle as explain_report
from tablelens.plans.specs import plan_specs, run_specs, validate_specs
from tablelens.sources.tables import TableLoadError, read_csv, read_table

__all__ = [
    "DEFAULT", "LensConfig", "TableLoadError", "build_dashboard", "chart_catalogue", "chart_frame", "clean",
    "column_stats", "explain_report", "plan_specs", "profile", "read_csv", "read_table", "run_specs", "validate_specs",
]
