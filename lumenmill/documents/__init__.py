"""Document-style queries: filters, updates, pipelines, a collection API and CQL."""
