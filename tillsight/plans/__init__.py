"""End-to-end plans composed from the operators."""

from tillsight.plans.report_run import ReportParams, run_report, stage

__all__ = ["ReportParams", "run_report", "stage"]
