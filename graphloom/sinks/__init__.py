"""Exports of a graph as text, JSON and XML."""
