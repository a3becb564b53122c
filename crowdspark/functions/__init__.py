"""Geometry and statistics as column expressions or small vectorised helpers."""
