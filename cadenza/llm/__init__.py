"""Training-data operators: each module holds one operator; ``entry`` registers their queries."""
