"""loomspan: polyline, voxel-grid and image analytics expressed as Spark DataFrame plans."""
