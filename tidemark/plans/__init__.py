"""Plan patterns shared by the operators."""
