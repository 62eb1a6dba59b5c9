"""Relational operators on points, cells, edges and symbols."""
