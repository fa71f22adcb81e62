"""Orders, numbering and transform pipelines."""
