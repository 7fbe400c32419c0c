"""Readers and writers: sequence files, sketch databases, profiles, taxonomies, results."""
