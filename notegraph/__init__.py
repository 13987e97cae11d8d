"""notegraph: hybrid retrieval, link-graph analytics and reference checks over note collections, on PySpark."""
