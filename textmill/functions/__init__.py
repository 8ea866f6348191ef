"""Column functions and pattern compilers."""
