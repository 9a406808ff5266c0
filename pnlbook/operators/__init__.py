"""DataFrame -> DataFrame operators of the journal."""
