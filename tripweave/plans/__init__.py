"""Run-level plans: preparation, summary registry and summary builders."""
