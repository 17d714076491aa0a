"""Timelines looked at by a model: the seam to it, and the runs that use it."""
