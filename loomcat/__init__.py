"""loomcat: a catalogue compiler expressed as Spark DataFrame plans."""
