"""Writers: graph documents, DOT, HTML, tables, HTTP."""
