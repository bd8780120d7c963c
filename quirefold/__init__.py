"""quirefold: packaged e-books and web pages to linked Markdown notes, as Spark plans."""
