"""Training-data operators: numbered operators over documents, pages and conversations."""
