"""Tables, files and adapters that give points."""
