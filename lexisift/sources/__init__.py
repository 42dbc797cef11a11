"""Documents in and out: bulk requests, operation logs, JSON documents and the catalog of tables."""
