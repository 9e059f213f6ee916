"""Column functions: vectors, boxes, names, paths, scores."""
