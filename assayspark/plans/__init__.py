"""Plan shapes that keep hot keys and long orderings distributed."""
