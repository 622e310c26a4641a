"""Training-data operators. Nothing outside this subpackage and corpus_pipeline imports it."""
