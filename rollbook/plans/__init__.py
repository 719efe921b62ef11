"""The study's pipelines, composed from the operators."""
