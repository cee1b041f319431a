"""vellumark: evidence analytics and text-data operators expressed as Spark plans."""
