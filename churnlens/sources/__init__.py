"""Inputs and outputs: planted and real-table subscriber fixtures, raw CSV, reports, exports."""
