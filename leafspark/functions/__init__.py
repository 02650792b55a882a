"""Column-level building blocks: no shuffle, evaluated inside whole-stage codegen."""
