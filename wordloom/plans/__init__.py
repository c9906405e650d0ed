"""The index facade, the catalog and the registered queries."""
