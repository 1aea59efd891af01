"""Column expressions as SQL text, generated unrolled so that they stay inside whole-stage codegen."""
