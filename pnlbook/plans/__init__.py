"""Query catalogue: named plans over the test tables and their SQL oracles."""
