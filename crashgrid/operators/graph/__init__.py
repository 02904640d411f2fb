"""Incident graph: vertices(id, node_type, ...) and edges(src, dst, rel_type, role, weight)."""
