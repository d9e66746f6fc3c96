"""DataFrame -> DataFrame operators over canonical posts."""
