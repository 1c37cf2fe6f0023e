"""Analytics over corpora of code and text, as Spark plans."""
