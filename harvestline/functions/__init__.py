"""Column functions: arithmetic, statuses, text, time, scoring."""
