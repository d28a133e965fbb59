"""codeloom: code and corpus analytics expressed as Spark plans."""
