"""Where graphs come from: tables, files in the usual graph formats, and generators."""
