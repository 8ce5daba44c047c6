"""scrivel: full-text search and web-corpus analytics on PySpark."""
