"""Spatial layout analytics for large point tables, written on the DataFrame API.

Points are profiled on a grid, the plane is cut into rectangles along grid
lines, the rectangles decide where rows live, and distance joins are run and
scored under such a layout.
"""
