"""Writers and keyed merges."""
