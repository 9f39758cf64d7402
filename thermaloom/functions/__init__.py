"""See the README for an overview of this subpackage."""
