"""Query front end: match language, engine facade and the query catalogue."""
