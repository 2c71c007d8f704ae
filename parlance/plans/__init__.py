"""Named queries over the projected tables, with the SQL that states the same result."""
