"""Sources and sinks: the object table, archives and manifests."""
