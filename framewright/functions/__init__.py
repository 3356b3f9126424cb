"""Part of framewright; see the package README."""
