"""Contest scoring, leaderboards and preference analytics as Spark DataFrame operators."""
