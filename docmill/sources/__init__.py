"""Sources and sinks: the document store, pages, embeddings, projects."""
