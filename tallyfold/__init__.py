"""tallyfold: strategy research over bars, expressed as Spark plans."""
