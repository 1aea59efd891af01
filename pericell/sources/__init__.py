"""Readers and writers: extended-XYZ text, configuration, model and checkpoint files, output tables."""
