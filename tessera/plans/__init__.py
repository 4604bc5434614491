"""Compositions of operators into whole workflows, and reports of their small results."""
