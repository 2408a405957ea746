"""Catalog quality control as Spark jobs.

Every operator takes DataFrames and returns DataFrames.  Rule sets are ordinary
tables (see ``shelfcheck.sources.rules``), so Spark's own size estimates decide
between broadcast and shuffle joins.
"""

from shelfcheck.operators.catalog import prepare_catalog
from shelfcheck.plans.preqc import final_report
from shelfcheck.plans.quality import quality_report
from shelfcheck.sources.rules import RuleSet

__all__ = ["RuleSet", "final_report", "prepare_catalog", "quality_report"]
