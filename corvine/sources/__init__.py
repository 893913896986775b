"""Readers: tables, configuration files, diffs, manifests, graph interchange."""
