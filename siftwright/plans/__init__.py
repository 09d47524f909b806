"""Named queries over the fixture tables, each with its oracle SQL."""
