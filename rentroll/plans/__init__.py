"""The jobs: invoices, bank exports, vacancy, dimensions, views, messages and the yearly run."""
