"""Programs: signals, registry, compiler, interpreter, diagnostics, sessions."""
