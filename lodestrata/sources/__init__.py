"""Readers and writers of the file formats that the operators work on."""
