"""Voxel, surface and flux operators: DataFrame in, DataFrame out."""
