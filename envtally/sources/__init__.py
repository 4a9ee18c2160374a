"""Input tables: candidate files, env files, loaders and the derived corpus."""
