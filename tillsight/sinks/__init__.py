"""Sinks: report tables, chart data and the key/value summary."""

from tillsight.sinks.publish import NotPublished, OutputSet, drop_unpublished, published, read_published
from tillsight.sinks.tables import write_reports, read_reports, report_manifest
from tillsight.sinks.charts import chart_series, write_chart_series
from tillsight.sinks.summary import summary

__all__ = ["NotPublished", "OutputSet", "chart_series", "drop_unpublished", "published", "read_published",
           "read_reports", "report_manifest", "summary", "write_chart_series", "write_reports"]
