"""Named reports and pipelines built from the operators."""
