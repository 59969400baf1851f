"""Where results go: meshes, drawings and tables."""
