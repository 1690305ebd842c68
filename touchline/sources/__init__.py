"""Sources: raw tables, derived views (passes, events, lineups, runs, scores), sinks."""
