"""Queries made of the operators, with SQL for another engine beside each."""
