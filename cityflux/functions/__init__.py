"""Column functions: pure Column -> Column, no Python at run time."""
