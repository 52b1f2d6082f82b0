"""DataFrame-in / DataFrame-out operators, generalised over key columns."""
