"""Column functions a task can ask for, and the order they run in."""
