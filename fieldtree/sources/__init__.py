"""Reading and writing fields, labels and arcs."""
