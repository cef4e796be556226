"""Directory building and directory analytics as lazy DataFrame operators on Spark."""
