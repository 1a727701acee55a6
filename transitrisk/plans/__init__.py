"""Query plans: journey search (depart-at / arrive-by), isochrones, timetable build."""
