"""Whole plans: the driver-table views, the query catalogue, the quality report and the fold job."""
