"""Readers and writers of point clouds, and clouds derived from tables."""
