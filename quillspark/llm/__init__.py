"""Operators that prepare training text: filtering, de-duplication, scoring, mixing and formatting.

Nothing outside this subpackage imports it. All operators take and return DataFrames; wherever a step
needs Python it runs over Arrow batches with array arithmetic, never one row at a time over the driver.
"""
