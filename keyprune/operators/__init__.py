"""Intersection, application, spatial pruning, maintenance."""
