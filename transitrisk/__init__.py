"""transitrisk: timetable, delay-risk and journey analytics as Spark jobs.

Every stage is a DataFrame operator; nothing is collected to the driver
except single numbers (row counts of a search frontier, size checks).
"""

__version__ = "0.1.0"
