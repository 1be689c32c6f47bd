"""DataFrame operators: classified requests, rollups, rankings, calendars, gaps."""
