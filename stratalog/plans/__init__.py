"""Plans over whole timelines, and the engine's queries with their SQL."""
