"""Relational operators on layered graphs.

Edges are rows (layer, src, dst, weight) with both directions stored; partitions
are rows (node, c); layer weights are rows (layer, node, w); interactions are
rows (layer, p, q, s).
"""
