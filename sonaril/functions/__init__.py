"""Column functions: everything here stays inside whole-stage code generation."""
