"""Named queries over the test tables, and the same results spelled in plain SQL."""
