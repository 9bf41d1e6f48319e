"""An extension beyond batch use: dumps as they arrive, and lattices per time window."""
