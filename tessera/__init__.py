"""tessera: knowledge retrieval, graph analytics and corpus operators as PySpark plans."""
