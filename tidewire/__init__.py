"""News and research intelligence operators expressed as Spark plans."""
