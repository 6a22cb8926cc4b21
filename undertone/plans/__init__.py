"""Named queries: each plan with the SQL that expresses the same result."""
