"""DataFrame operators: timetable, paths, walks, delay models, clustering, transfers."""
