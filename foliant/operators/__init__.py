"""DataFrame operators on pages, blocks, chunks, tables, reviews and runs."""
