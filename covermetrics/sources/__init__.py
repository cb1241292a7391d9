from covermetrics.sources.book import Book  # noqa: F401
