"""Operators on frames, atoms and pairs.

frames: frame_id, cell (nine numbers, rows are lattice vectors), energy, virial
atoms:  frame_id, atom_id, type, x, y, z
pairs:  frame_id, i, j, ti, tj, dx, dy, dz, d (directed, both directions)
"""
