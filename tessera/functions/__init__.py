"""Part of the array engine; see the package's README."""
