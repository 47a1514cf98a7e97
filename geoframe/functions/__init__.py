"""Column expressions: rotations, poses, cameras, two-view residuals and geodesy."""
