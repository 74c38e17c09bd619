"""Named queries over the test tables and, where SQL can state them, their SQL twins."""
