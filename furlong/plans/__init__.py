"""The jobs: ingest, features, predictions, evaluation, analytics, reports."""
